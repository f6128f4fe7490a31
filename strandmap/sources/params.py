"""Parameter files of ``NAME = value`` lines, with overrides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str) -> DataFrame:
    """name, value: comments (#) and quotes taken off; of repeated names the first line counts."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("n"), F.regexp_replace("value", r"(^|\s)#.*$", "").alias("line"))
    part = lambda k: F.regexp_extract("line", r"^\s*([A-Za-z_]\w*)\s*=\s*(.*?)\s*$", k)
    got = lines.select("n", F.upper(part(1)).alias("name"), F.regexp_replace(part(2), r"""^(['"])(.*)\1$""", "$2").alias("value")).filter("name <> ''")
    return got.groupBy("name").agg(F.min_by("value", "n").alias("value"))


class Parameters:
    """Typed access; later sources override earlier ones: file, then a dict, then ``--NAME=value`` arguments."""

    def __init__(self, table: DataFrame | None = None, values: dict[str, object] | None = None, arguments: list[str] | None = None):
        self.values: dict[str, str] = {r["name"]: r["value"] for r in table.collect()} if table is not None else {}
        self.values |= {k.upper(): str(v) for k, v in (values or {}).items()}
        for a in arguments or []:
            name, sep, value = a.lstrip("-").partition("=")
            if sep:
                self.values[name.upper()] = value

    def text(self, name: str, default: str | None = None) -> str:
        if name.upper() not in self.values and default is None:
            raise KeyError(f"parameter {name} is missing")
        return self.values.get(name.upper(), default)

    def integer(self, name: str, default: int | None = None) -> int:
        return int(self.text(name, None if default is None else str(default)))

    def number(self, name: str, default: float | None = None) -> float:
        return float(self.text(name, None if default is None else str(default)).lower().replace("d", "e"))

    def flag(self, name: str, default: bool | None = None) -> bool:
        value = self.text(name, None if default is None else str(default)).strip(".").lower()
        if value not in ("t", "true", "1", "yes", "f", "false", "0", "no"):
            raise ValueError(f"{name}: not a truth value: {value}")
        return value in ("t", "true", "1", "yes")
