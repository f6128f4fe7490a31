"""Bounded samples of labelled rows, and fitting small models on them in one task."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches

#: Bytes of text a label gives at most, and of a text that is learned from. Texts are taken whole or not at all.
MOST_BYTES, LONGEST = 8 << 20, 1 << 20


def labelled_sample(docs: DataFrame, marks: DataFrame | None, most: int, most_bytes: int = MOST_BYTES, longest: int = LONGEST) -> tuple[DataFrame, dict[object, int]]:
    """At most ``most`` distinct texts (text, y, u) and ``most_bytes`` a label, by a hash u of the row: the same at every run.

    ``docs`` has the columns id and text, and y if ``marks`` (id, y) is None; rows with a null y don't count, nor do
    texts of more than ``longest`` bytes. Also returns the rows of each label. A hash threshold that the label's distinct
    rows set leaves a little more than ``most`` a label; of these copies are taken together and the least by hash are
    taken, all before anything comes to the driver. With ``marks`` the ids are chosen first, from the labels alone, and
    broadcast, so no text is shuffled but the sample's. Labels must be few.
    """
    known = (docs if marks is None else marks).filter(F.col("y").isNotNull())
    if marks is None:
        known = known.withColumn("text", F.coalesce("text", F.lit(""))).filter(F.octet_length("text") <= longest)
    h = F.xxhash64("text" if marks is None else "id")
    u = F.shiftrightunsigned(h, 11) / float(1 << 53)
    seen = known.groupBy("y").agg(F.count("*").alias("n"), F.approx_count_distinct(h, 0.02).alias("distinct")).collect()
    share = F.lit(0.0)
    for r in sorted(seen, key=lambda r: str(r["y"])):
        share = F.when(F.col("y") == r["y"], F.lit(min(1.0, 1.3 * most / max(1, r["distinct"])))).otherwise(share)
    rows = known.withColumn("u", u).filter(F.col("u") <= share)
    first = Window.partitionBy("y").orderBy("u")
    if marks is not None:
        chosen = rows.groupBy("y", "u").agg(F.min("id").alias("id")).withColumn("k", F.row_number().over(first)).filter(F.col("k") <= most)
        rows = docs.join(F.broadcast(chosen.select("id", "y", "u")), "id").select("y", "u", F.coalesce("text", F.lit("")).alias("text"))
        rows = rows.filter(F.octet_length("text") <= longest)
    rows = rows.groupBy("y", "u").agg(F.min("text").alias("text"))  # of an id that repeats, one text
    rows = rows.withColumn("k", F.row_number().over(first)).withColumn("bytes", F.sum(F.octet_length("text")).over(first.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.filter((F.col("k") <= most) & (F.col("bytes") <= most_bytes)).select("text", "y", "u"), {r["y"]: r["n"] for r in seen}


def in_order(rows: list[tuple]) -> list[tuple[str, object]]:
    """(text, label) of a sample's rows (text, y, u), in an order that depends on the rows alone."""
    return [(t, y) for t, y, _ in sorted(rows, key=lambda r: (str(r[1]), r[2]))]


def fitted(rows: DataFrame, train: Callable[[list[tuple[str, object]]], object]) -> object:
    """``train`` of a sample, in one task: neither texts nor what training needs come to the driver, only the model."""
    small_batches(rows.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = [r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)]
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(train(in_order(some)))], pa.binary())})

    got = rows.select("text", "y", "u").repartition(1).mapInArrow(work, "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else train([])


def temperature(logits, y) -> float:
    """The temperature under which softmax(logits / T) has the least loss on held-back rows."""
    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(y)), y]).mean())

    return min(np.geomspace(0.2, 20, 60).tolist(), key=loss) if len(y) else 1.0
