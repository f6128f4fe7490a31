"""Document fingerprints: bottom-k sketches of word-shingle hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Ranges, ascii_lower, literal, partitions

SHINGLE, K, DIGITS = 5, 256, 12
#: Range of the hashes: 4 bits a hex digit.
SPAN = float(2 ** (4 * DIGITS))


def with_sketch(df: DataFrame, text: str, out: str, k: int = K, words: int = SHINGLE) -> DataFrame:
    r"""Adds ``out``: the k smallest distinct hashes of the text's shingles, ascending (array of long).

    Words are runs of other than ``[\x20\x09-\x0D]`` with A-Z lower-cased; a text of fewer than ``words``
    words is one shingle; one without words has an empty sketch. Null text counts as empty.
    """
    split = F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), "[\\x20\\x09-\\x0D]+", -1)
    hashes = F.transform(F.filter(split, lambda w: w != ""), lambda w: F.xxhash64(w))
    df = df.withColumn("_w", hashes)
    w, n = F.col("_w"), F.size("_w")
    at = lambda i, j: F.get(w, i + F.lit(j))
    cut = lambda h: F.shiftrightunsigned(h, 64 - 4 * DIGITS)
    many = F.transform(F.sequence(F.lit(0), n - words), lambda i: cut(F.xxhash64(*[at(i, j) for j in range(words)])))
    few = F.array(cut(F.xxhash64(F.lit(words), w)))
    all_of = F.when(n >= words, many).when(n > 0, few).otherwise(F.array().cast("array<long>"))
    return df.withColumn(out, F.slice(F.sort_array(F.array_distinct(all_of)), 1, k)).drop("_w")


def to_hex(sketch: Column) -> Column:
    """The sketch as one string, ``DIGITS`` hex digits a hash."""
    return F.lower(F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), DIGITS, "0")), ""))


def merged(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of what a and b sketch."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated intersection over union, 0 to 1; two empty sketches are alike (1). Exact below k shingles."""
    u = merged(a, b, k)
    both = F.array_intersect(F.array_intersect(a, b), u)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.size(both) / F.size(u))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * SPAN / F.element_at(a, k))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b holds, 0 to 1 (1 if a has none)."""
    both = resemblance(a, b, k) * distinct_count(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_count(a, k)))


def merge_by(df: DataFrame, keys: list[str], sketch: str, k: int = K, fan: int = 64) -> DataFrame:
    """One sketch for each group of rows: a tree of merges of about ``fan`` sketches each, so no task gathers a group.

    ``df`` must hold ``keys`` and ``sketch``. Groups keep null keys; null sketches count as empty.
    """
    none = F.array().cast("array<long>")
    cur = df.select(*keys, F.coalesce(F.col(sketch), none).alias("_s")).distinct()  # so that a hash of the sketch deals out a group
    most = cur.groupBy(*keys).count().agg(F.max("count")).head()[0] or 0
    while True:
        parts = -(-most // fan)
        salt = F.pmod(F.xxhash64("_s", F.lit(most)), F.lit(max(1, parts)))
        step = cur.withColumn("_p", salt).groupBy(*keys, "_p").agg(F.collect_list("_s").alias("_all"))
        cur = step.select(*keys, F.slice(F.sort_array(F.array_distinct(F.flatten("_all"))), 1, k).alias("_s"))
        if parts <= 1:
            return cur.withColumnRenamed("_s", sketch)
        most = parts


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, text (null: empty) and ``next``, the text of the next row by descending id.

    After the last comes the first. Rows of one id follow each other by text. Rows go to key ranges, each sorted
    by itself; a range gets a copy of the row before it, so no task sees the whole table and text moves once.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ranges = Ranges(base.select("id"), "id", max(32, 3 * partitions(docs.sparkSession)))
    base = base.withColumn("bucket", ranges.bucket())
    tops = sorted((r["bucket"], r["top"]) for r in base.groupBy("bucket").agg(F.max(F.coalesce("id", F.lit(-(2**63)).cast("long"))).alias("top")).collect())
    if not tops:
        return base.withColumn("ghost", F.lit(False)).withColumn("next", F.col("text"))
    size = tops[-1][0] + 1
    top, follower = [None] * size, [0] * size
    for (b, t), (after, _) in zip(tops, [*tops[1:], tops[0]], strict=True):
        top[b], follower[b] = t, after
    b = F.col("bucket") + 1
    is_top = F.coalesce("id", F.lit(-(2**63)).cast("long")) == F.element_at(literal(top, "array<bigint>"), b)
    place = lambda bucket, ghost: F.struct(bucket.cast("int").alias("bucket"), F.lit(ghost).alias("ghost"))
    own, copy = place(F.col("bucket"), False), place(F.element_at(literal(follower, "array<int>"), b), True)
    dealt = base.withColumn("_to", F.explode(F.when(is_top, F.array(own, copy)).otherwise(F.array(own)))).select("id", "text", "_to.*")
    by = Window.partitionBy("bucket").orderBy(F.col("ghost").desc(), F.col("id").asc_nulls_first(), "text")
    return dealt.withColumn("next", F.lag("text").over(by))


def fingerprint_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited text.

    The edited text replaces the last floor(n/3) of n code points by as many first ones (or all) of the next
    document by descending id. Returns one row per input row: id, n_chars, edited (text), sketch, edited_sketch,
    near_edited and near_next (estimated likeness to the edited text and to the next document).
    """
    df = with_next(docs, id_col, text_col)
    by = Window.partitionBy("bucket").orderBy(F.col("ghost").desc(), F.col("id").asc_nulls_first(), "text")
    df = with_sketch(df, "text", "sketch", k).withColumn("next_sketch", F.lag("sketch").over(by)).filter(~F.col("ghost"))
    n = F.char_length("text")
    m = F.floor(n / 3).cast("int")
    df = df.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - m), F.substring("next", F.lit(1), m)))
    df = with_sketch(df.drop("next"), "edited", "edited_sketch", k)
    return df.select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited",
        "sketch",
        "edited_sketch",
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).cast(T.DoubleType()).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).cast(T.DoubleType()).alias("near_next"),
    )
