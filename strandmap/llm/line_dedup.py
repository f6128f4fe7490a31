"""Line dedup: explode normalised lines, hash them, count documents by hash, drop and reassemble."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, drop, row_key, stored

BLANKS = " \t\n\x0b\f\r"


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    r"""Drops lines that many documents share, keeping them in the largest id that holds them.

    Returns one row per input row: ``id_col``, n_lines, n_dropped and kept_text. A line's key is the line
    stripped of ``[\x20\x09-\x0D]`` and with A-Z lower-cased; keys of at least ``min_chars`` code points that
    occur in at least ``min_docs`` distinct ids lose all their lines but those of the largest id.
    Null or empty text is one empty line. Equal rows get equal results. Rows with a null id count for no key
    and hold none, so they lose every line of a dropped key. Other columns of ``docs`` are not read.

    Keys are compared by 128 bits of hash. Counting is two aggregations (by key and id, then by key), so a
    line in a third of all documents is summed before it moves; the join that brings the decision back is an
    equi-join of (key, row) postings, whose large partitions adaptive execution splits. Text moves once.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.select("id", "text", *[k.alias(f"r{i}") for i, k in enumerate(row_key(F.col("id"), F.col("text")))])
    keys = F.transform(F.split(ascii_lower(F.col("text")), "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)))
    lines = base.select("id", "r0", "r1", F.posexplode(keys).alias("pos", "key")).filter(F.char_length("key") >= min_chars)
    lines = stored(lines.select("id", "r0", "r1", "pos", *[k.alias(f"h{i}") for i, k in enumerate(row_key(F.col("key")))]), "lines")
    common = lines.groupBy("h0", "h1").agg(F.count_distinct("id").alias("n"), F.max("id").alias("keeper")).filter(F.col("n") >= min_docs)
    common = stored(common, "common")  # a table, so that adaptive execution can split the join with a very common line
    hit = lines.join(common, ["h0", "h1"]).filter(F.coalesce(F.col("id") != F.col("keeper"), F.lit(True)))
    gone = stored(hit.groupBy("r0", "r1").agg(F.collect_set("pos").alias("gone")), "gone")
    drop(lines, common)
    out = base.join(gone, ["r0", "r1"], "left").withColumn("lines", F.split("text", "\n", -1))
    n = F.size("lines")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), n - 1), F.col("gone")), lambda i: F.get(F.col("lines"), i))
    return out.select(
        F.col("id").alias(id_col),
        n.cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
    )
