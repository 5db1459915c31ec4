"""URL filters: rules first, then gradient-boosted trees on lexical features.

Features are column expressions; the trees are Spark ML's, trained on a bounded sample of labelled URLs. The
labels of one half of the labelled URLs give the statistics of suffixes, those of the other half train the
trees, so that no label is in a feature of its own row.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import columns, cut, few, let, lower_ascii, table

#: (rule, verdict): a host with its subdomains, and the start of a path.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
#: Labelled URLs that the trees are trained on (expected; drawn by hash).
TRAINED_ON = 20_000
TREES, DEPTH = 12, 4
#: Labelled URLs that each suffix is credited with at the overall block rate.
PRIOR_WEIGHT = 20.0
FEATURES = ["length", "host_length", "labels", "depth", "digit_ratio", "entropy", "parameters", "hyphens", "fragment", "suffix_share", "suffix_blocked", "first_share", "first_blocked"]


def parts(url: Column) -> Column:
    """host and path; a url that is null or has no `://` has neither."""
    url = F.coalesce(url, F.lit(""))
    after = F.when(F.instr(url, "://") > 0, F.expr("substring(coalesce(url, ''), instr(coalesce(url, ''), '://') + 3)")).otherwise(F.lit(""))
    return let(after, lambda a: F.struct(lower_ascii(F.regexp_extract(a, r"\A[^/?#]*", 0)).alias("host"), F.regexp_extract(a, r"\A[^/?#]*([^?#]*)", 1).alias("path")))


def apply_rules(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, or null."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + rest))
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _entropy(text: Column) -> Column:
    n = F.length(text)

    def share(c: Column) -> Column:
        p = (n - F.length(F.replace(text, c, F.lit("")))) / n
        return -p * F.log2(p)

    chars = F.filter(F.array_sort(F.array_distinct(F.split(text, ""))), lambda c: c != "")
    return F.coalesce(F.aggregate(F.transform(chars, share), F.lit(0.0), lambda a, x: a + x), F.lit(0.0))


def lexical(rows: DataFrame) -> DataFrame:
    """Add the features that follow from the url alone, its suffix (last label of the host) and its first path part."""
    url = F.coalesce(F.col("url"), F.lit(""))
    return rows.withColumns(
        {
            "length": F.length(url).cast("double"),
            "host_length": F.length("host").cast("double"),
            "labels": (F.length("host") - F.length(F.replace("host", F.lit("."), F.lit("")))).cast("double"),
            "depth": F.regexp_count("path", F.lit("/[^/]")).cast("double"),
            "digit_ratio": F.regexp_count(url, F.lit("[0-9]")) / F.greatest(F.length(url), F.lit(1)),
            "entropy": _entropy(url),
            "parameters": F.regexp_count(url, F.lit(r"[?&][^=&#]+=")).cast("double"),
            "hyphens": F.regexp_count("host", F.lit("-")).cast("double"),
            "fragment": F.contains(url, F.lit("#")).cast("double"),
            "suffix": F.regexp_extract("host", r"([^.]*)\z", 1),
            "first": F.regexp_extract("path", r"\A/([^/]*)", 1),
        }
    )


def _half() -> Column:
    return F.pmod(F.xxhash64("url", F.lit("half")), F.lit(2))


def suffix_statistics(rows: DataFrame, key: str) -> DataFrame:
    """For each value of `key` its share of all rows and its smoothed block rate among labelled ones of the first half."""
    label = F.when(_half() == 0, F.col("label"))
    by = cut(rows.groupBy(key).agg(F.count("*").alias("n"), F.count(label).alias("known"), F.sum(label).alias("blocked")))
    total = by.agg(F.sum("n").alias("all_n"), F.sum("known").alias("all_known"), F.coalesce(F.sum("blocked"), F.lit(0.0)).alias("all_blocked")).first()
    n, known, blocked = (total["all_n"] or 1, total["all_known"] or 0, total["all_blocked"])
    rate = (blocked + 1) / (known + 2)
    return by.select(
        F.col(key).alias(f"{key}_of"),
        (F.col("n") / F.lit(float(n))).alias(f"{key}_share"),
        ((F.coalesce(F.col("blocked"), F.lit(0.0)) + PRIOR_WEIGHT * rate) / (F.col("known") + PRIOR_WEIGHT)).alias(f"{key}_blocked"),
    )


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules: list[tuple[str, str]] = RULES, trained_on: int = TRAINED_ON) -> DataFrame:
    """Judge every url of `pages` (page_id, url).

    A rule's verdict stands; other urls get the trees' verdict, `block` from a probability of 0.5 on.
    `labelled` has url and label (1 is block, 0 allow); without it, the urls that a rule covers are the
    labelled ones. A url that is null or has no `://` has an empty host and path and is judged by the trees.
    Where labels are of one kind only, that kind is the verdict of all others (allow without any). Null ids
    and repeated rows are judged like others, an empty table gives no rows, extra columns are not carried.
    """
    blocked = F.create_map(*[F.lit(x) for rule, verdict in rules for x in (rule, float(verdict == "block"))])
    rows = columns(pages, page_id="long", url="string").withColumn("part", parts(F.col("url")))
    rows = rows.select("page_id", "url", F.col("part.host").alias("host"), F.col("part.path").alias("path"))
    rows = rows.withColumn("rule", apply_rules(F.col("host"), F.col("path"), rules)).withColumn("by_rule", F.get(F.array(blocked[F.col("rule")]), F.lit(0)))
    rows = lexical(rows)
    if labelled is None:
        known = rows.withColumn("label", F.col("by_rule"))
    else:
        marks = columns(labelled, url="string", label="double").where("label IS NOT NULL").withColumn("part", parts(F.col("url")))
        known = lexical(marks.select("url", "label", F.col("part.host").alias("host"), F.col("part.path").alias("path")))
    rows = cut(rows)
    known = cut(rows.withColumn("label", F.col("by_rule"))) if labelled is None else known
    for key in ("suffix", "first"):
        stats = few(cut(suffix_statistics(known, key)))
        rate = {f"{key}_share": 0.0, f"{key}_blocked": 0.5}
        rows = rows.join(stats, rows[key] == stats[f"{key}_of"], "left").drop(f"{key}_of").fillna(rate)
        known = known.join(stats, known[key] == stats[f"{key}_of"], "left").drop(f"{key}_of").fillna(rate)
    kinds = {r[0]: r[1] for r in known.where("label IS NOT NULL").groupBy("label").count().collect()}
    verdict = F.when(F.col("by_rule") == 1.0, F.lit("block")).when(F.col("by_rule") == 0.0, F.lit("allow"))
    if len(kinds) < 2:
        only = "block" if kinds.get(1.0) else "allow"
        return rows.select("page_id", "host", "path", "rule", F.coalesce(verdict, F.lit(only)).alias("verdict"), F.lit(float(only == "block")).alias("probability"))
    # one half of the labelled rows, or all of them where that half has labels of one kind only
    halves = known.where(F.col("label").isNotNull() & (_half() == 1))
    if halves.select("label").distinct().count() < 2:
        halves = known.where("label IS NOT NULL")
    share = min(1.0, trained_on / max(1, halves.count()))
    drawn = halves.where(F.pmod(F.xxhash64("url"), F.lit(2**30)) < share * 2**30).select("label", *FEATURES)
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="features")
    # the sample is bounded by trained_on; one partition makes the sums, and so the trees, the same each time
    sample = cut(assemble.transform(drawn).select("label", "features").repartition(1).sortWithinPartitions("label", F.xxhash64(vector_to_array("features"))))
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7).fit(sample)
    judged = trees.transform(assemble.transform(rows)).withColumn("probability", F.get(vector_to_array("probability"), F.lit(1)))
    model = F.when(F.col("probability") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce(verdict, model).alias("verdict"), "probability")


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
