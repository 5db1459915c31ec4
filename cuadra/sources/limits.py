"""Input caps: going over one ends the read there, fails it, and names the way to raise the cap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..errors import IngestionError


def enforce(label: str, name: str, value: int, cfg: Config, archive: str = "") -> None:
    most = getattr(cfg.limites_ingesta, name)
    if value > most:
        flag = "--" + name.replace("_", "-")
        text = f"{label}: excede limite `{name}`: {value} > {most}. Override seguro: config `limites_ingesta.{name}` o flag `{flag}`."
        raise IngestionError(text, {"archivo": archive, "limit": name, "value": value, "max_value": most, "cfg_path": f"limites_ingesta.{name}", "cli_flag": flag})


def check_size(spark: SparkSession, path: str, cfg: Config, label: str) -> None:
    """By the listing of the files, without reading them."""
    largest = spark.read.format("binaryFile").load(path).select(F.struct("length", "path").alias("f")).agg(F.max("f")).first()[0]
    if largest is not None:
        enforce(label, "max_input_bytes", largest["length"], cfg, largest["path"].rsplit("/", 1)[-1])


#: Marks the error of a read that ran into a cap; what follows is its name and the count at which it stopped.
MARK = "limite:"


class Exceeded(Exception):
    """A reader's own stop at a cap."""

    def __init__(self, name: str, value: int):
        super().__init__(f"{MARK}{name}:{value}")


class Counter:
    """Counts what a reader has taken from one file; going over a cap ends the read there."""

    def __init__(self, **most: int):
        self.most, self.seen = most, dict.fromkeys(most, 0)

    def add(self, **counts: int) -> None:
        for name, n in counts.items():
            self.seen[name] += n
            if self.seen[name] > self.most[name]:
                raise Exceeded(name, self.seen[name])


def caps(cfg: Config, *names: str) -> dict[str, int]:
    return {name: getattr(cfg.limites_ingesta, name) for name in names}


def check(raw: DataFrame, cfg: Config, label: str) -> None:
    """Fail for the first file whose read stopped at a cap."""
    bad = raw.where(F.startswith("error", F.lit(MARK))).agg(F.min(F.struct("archivo", "error"))).first()[0]
    if bad is not None:
        _, name, value = bad["error"].split(":")
        enforce(label, name, int(value), cfg, bad["archivo"])
