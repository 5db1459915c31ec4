import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from cuadra.llm import suffixes


def test_the_filter_reaches_the_driver_without_an_object_for_each_word(spark):
    hashes = spark.range(200_000).select(F.xxhash64("id").alias("h"))
    tracemalloc.start()
    try:
        bits = suffixes._filter(hashes, 2**18)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    known = np.array([r[0] for r in hashes.collect()], np.int64).view(np.uint64)
    want = np.zeros(2**22, bool)
    want[(known >> np.uint64(42)).astype(np.int64)] = True
    assert len(bits) == 2**16 and (np.unpackbits(bits.view(np.uint8), bitorder="little").astype(bool) == want).all()
    assert suffixes._has(bits, known).all()
    # the words themselves take half a megabyte
    assert most < 5 * 2**20, most


def test_the_filter_of_no_hash_is_empty(spark):
    assert not suffixes._filter(spark.range(0).select(F.col("id").alias("h")), 0).any()
