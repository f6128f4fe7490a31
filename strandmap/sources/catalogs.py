"""Text catalogs: run lists, detectors, patches, frequency masks, accept lists and split words."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import scan_mode, tokens
from ..runtime import ship


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of small catalogs in order, each file by itself: path, n (from 0), t (tokens)."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.split("value", r"\r?\n").alias("lines"))
    rows = whole.select("path", F.posexplode("lines").alias("n", "line")).select("path", "n", tokens(F.regexp_replace("line", "#.*$", "")).alias("t"))
    return rows.filter(F.size("t") > 0)


def _word(i: int, kind: str = "string") -> Column:
    return F.get("t", F.lit(i)).try_cast(kind)


def _table(spark: SparkSession, path: str, schema: list[tuple[str, str]]) -> DataFrame:
    return _lines(spark, path).select(*[_word(i, k).alias(n) for i, (n, k) in enumerate(schema)])


def detectors(spark: SparkSession, path: str) -> DataFrame:
    kinds = [("id", "int"), ("telescope", "int"), ("horn", "int"), ("theta", "double"), ("phi", "double"), ("psi", "double"), ("fwhm", "double"), ("freq", "double"), ("ok", "int")]
    return _table(spark, path, kinds).withColumn("ok", F.coalesce(F.col("ok") != 0, F.lit(True)))


def alive(detector_table: DataFrame) -> DataFrame:
    return detector_table.filter("ok")


def patches(spark: SparkSession, path: str) -> DataFrame:
    """Fixed patches with a place in degrees; moving ones (x for a coordinate) with none."""
    kinds = [("name", "string"), ("phi", "double"), ("theta", "double"), ("obj_rad", "double"), ("img_rad", "double"), ("resolution", "double"), ("priority", "int"), ("type", "string")]
    return _table(spark, path, kinds).withColumn("fixed", F.col("phi").isNotNull() & F.col("theta").isNotNull())


def frequency_rules(spark: SparkSession, path: str) -> DataFrame:
    """freq, sb, det of a mask file, whose first line holds the number of channels; 0 stands for all."""
    first = Window.partitionBy("path")
    rows = _lines(spark, path).withColumn("_first", F.min("n").over(first))
    return rows.filter("n > _first").select(_word(0, "int").alias("freq"), _word(1, "int").alias("sb"), _word(2, "int").alias("det"))


def _count(words: list[str], i: int) -> int:
    """The whole number at a place; 0 if there is none."""
    try:
        return int(words[i])
    except (IndexError, ValueError):
        return 0


def _walked(batches):
    """Batches of (object, words of the scan's head, words of the sub-scan) from whole run lists."""
    kind = pa.struct([("object", pa.string()), ("scan", pa.list_(pa.string())), ("sub", pa.list_(pa.string()))])
    for batch in batches:
        for value in batch.column(0):
            name, scan, scans, subs, out = None, [], 0, 0, []
            heads = (words for line in re.split(r"\r?\n", value.as_py() or "") if (words := [w for w in re.split(r"[ \t]", line) if w]))
            next(heads, None)  # the number of objects
            for words in heads:
                if subs > 0:
                    subs -= 1
                    out.append({"object": name, "scan": scan, "sub": words})
                    if len(out) == 10_000:
                        yield pa.record_batch([pa.array(out, kind)], ["r"])
                        out = []
                elif scans > 0:
                    scans, scan, subs = scans - 1, words, _count(words, 3)
                else:
                    name, scans = words[0], _count(words, 1)
            yield pa.record_batch([pa.array(out, kind)], ["r"])


def run_list(spark: SparkSession, path: str, target: str | None = None) -> DataFrame:
    """A row a sub-scan of ``number of objects; name scans; id mjd1 mjd2 subscans ... file; id mjd1 mjd2 feature az el dk ...``.

    How many lines belong to a header is written in it, so heads are told apart by walking through counts, one pass
    over a file's lines. The lists are catalogs of one file each.
    """
    ship(spark)
    rows = spark.read.text(path, wholetext=True).mapInArrow(_walked, "r struct<object:string,scan:array<string>,sub:array<string>>")
    s, u = (lambda i, k: F.get("r.scan", F.lit(i)).try_cast(k)), (lambda i, k: F.get("r.sub", F.lit(i)).try_cast(k))
    got = rows.select(
        F.col("r.object").alias("object"), s(0, "int").alias("scan_id"), s(1, "double").alias("scan_start"), s(2, "double").alias("scan_end"), F.element_at("r.scan", -1).alias("file"),
        u(0, "int").alias("sub_id"), u(1, "double").alias("start"), u(2, "double").alias("end"), u(3, "int").alias("feature"), u(4, "double").alias("az"), u(5, "double").alias("el"), u(6, "double").alias("dk"),
    ).withColumn("mode", scan_mode(F.col("feature")))
    return got if target is None else got.filter(F.col("object") == target)


def science_subscans(runs: DataFrame) -> DataFrame:
    """Sub-scans but the first and last of a scan, which calibrate."""
    w = Window.partitionBy("scan_id")
    i = F.row_number().over(w.orderBy("start"))
    return runs.withColumn("_i", i).withColumn("_n", F.count("*").over(w)).filter("_i > 1 AND _i < _n").drop("_i", "_n")


def write_run_list(runs: DataFrame, path: str) -> None:
    """The same text, one file an object, from which run_list() reads the rows back."""
    text = lambda *cols: F.concat_ws(" ", *[F.col(c).cast("string") for c in cols])
    scan = ["object", "scan_id", "scan_start", "scan_end", "file"]
    level, none = (lambda n: F.lit(n).alias("_level")), F.lit(None).cast("double").alias("start")
    heads = runs.groupBy(*scan).agg(F.count("*").cast("string").alias("_n"))
    lines = runs.select(*scan, level(2), F.col("start").cast("double").alias("start"), text("sub_id", "start", "end", "feature", "az", "el", "dk").alias("value"))
    lines = lines.union(heads.select(*scan, level(1), none, F.concat_ws(" ", text("scan_id", "scan_start", "scan_end"), "_n", "file")))
    top = heads.groupBy("object").agg(F.concat("object", F.lit(" "), F.count("*").cast("string")).alias("value"))
    first = F.concat_ws("\n", F.lit("1"), "value")
    order = ["object", F.col("_level") > 0, "scan_id", "scan_start", "scan_end", "file", "_level", "start", "value"]
    lines.unionByName(top.select("object", level(0), first.alias("value")), True).repartition("object").sortWithinPartitions(*order).select("object", "value").write.partitionBy("object").text(path)


def rejected_channels(spark: SparkSession, path: str) -> DataFrame:
    """scan, det, sb, freq of an accept list: ``scans``, then ``scan detectors; det sidebands; sb rejected; freqs``."""
    doc = spark.read.text(path, wholetext=True).select(tokens(F.regexp_replace("value", r"\s+", " ")).alias("t"))
    kind = "array<struct<scan:int,det:int,sb:int,freq:int>>"
    zero = lambda n: F.lit(0).alias(n)
    start = F.struct(zero("dets"), zero("sbs"), zero("freqs"), zero("want"), zero("scan"), zero("det"), zero("sb"), F.array().cast(kind).alias("out"))

    def with_(a: Column, **new: Column) -> Column:
        return F.struct(*[(new.get(f, a[f])).alias(f) for f in ("dets", "sbs", "freqs", "want", "scan", "det", "sb", "out")])

    def step(a: Column, w: Column) -> Column:
        v = w.cast("int")
        row = F.struct(a["scan"].alias("scan"), a["det"].alias("det"), a["sb"].alias("sb"), v.alias("freq"))
        # want: what the open head waits for; 1 detectors of a scan, 2 sidebands of a detector, 3 rejects of a sideband
        return (
            F.when(a["want"] == 1, with_(a, dets=v, want=F.lit(0)))
            .when(a["want"] == 2, with_(a, sbs=v, want=F.lit(0)))
            .when(a["want"] == 3, with_(a, freqs=v, want=F.lit(0)))
            .when(a["freqs"] > 0, with_(a, freqs=a["freqs"] - 1, out=F.concat(a["out"], F.array(row))))
            .when(a["sbs"] > 0, with_(a, sbs=a["sbs"] - 1, sb=v, want=F.lit(3)))
            .when(a["dets"] > 0, with_(a, dets=a["dets"] - 1, det=v, want=F.lit(2)))
            .otherwise(with_(a, scan=v, want=F.lit(1)))
        )

    rest = F.slice("t", F.lit(2), F.greatest(F.size("t") - 1, F.lit(0)))
    return doc.select(F.explode(F.aggregate(rest, start, step, lambda a: a["out"])).alias("r")).select("r.*")


def accepted(channels: DataFrame, rejects: DataFrame) -> DataFrame:
    return channels.join(rejects, ["scan", "det", "sb", "freq"], "left_anti")


def split_definitions(spark: SparkSession, path: str) -> DataFrame:
    """name and kind (0 co-add, 1 feed, 2 test, 3 control) in order of their bits, from 1."""
    rows = _lines(spark, path).filter(_word(1, "int").isNotNull())
    return rows.select(F.row_number().over(Window.partitionBy("path").orderBy("n")).alias("bit"), _word(0).alias("name"), _word(1, "int").alias("kind"))


def time_ranges(spark: SparkSession, path: str, time: str) -> DataFrame:
    """First and last time of each file, from the time column alone; files that can't be read are passed over."""
    df = spark.read.option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "true").parquet(path)
    return df.select(F.col("_metadata.file_path").alias("file"), time).groupBy("file").agg(F.min(time).alias("start"), F.max(time).alias("end"))


def new_files(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """Files below a folder that a catalog doesn't know yet: path, length, modified."""
    got = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.col("modificationTime").alias("modified"))
    return got if known is None else got.join(known.select("path"), "path", "left_anti")


LEVEL2 = T.StructType([T.StructField(n, k) for n, k in (("scan_id", T.LongType()), ("feed", T.IntegerType()), ("sb", T.IntegerType()), ("freq", T.IntegerType()), ("i", T.LongType()), ("t", T.DoubleType()), ("value", T.FloatType()))])
