"""The pipeline's stages, each against brute force on what its predecessor kept."""

import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as cp
from strandmap.llm import langid, mixing
from strandmap.llm.queries import tokenizer_path
from tests.llm.test_corpus_operators import brute_groups, brute_hits

SF = "/root/testdata/sf0.001"


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_stages(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.withColumn("r0", F.lit("extra")).unionByName(docs.limit(1).select((F.lit(10**6)).cast("long").alias("doc_id"), F.lit("1 2 3").alias("text"), "lang", "source", "n_chars", F.lit("extra").alias("r0")))
    columns = docs.columns
    assert [n for n, _ in cp.STAGES] == ["language", "near_duplicates", "decontamination", "mixture", "tokens"]

    kept = cp.language(spark, docs, SF)
    assert kept.columns == columns
    model = langid.fit(docs)
    p = {i: model.probabilities(*langid.joined([t or ""]))[0] for i, t in pairs(docs)}
    assert {i for i, _ in pairs(kept)} == {i for i, t in pairs(docs) if any(map(str.isalpha, t or "")) and p[i].max() >= model.least}
    assert kept.count() >= docs.count() - 3

    one = cp.near_duplicates(spark, kept, SF)
    assert one.columns == columns
    assert {i for i, _ in pairs(one)} == {i for i, _, _, k in brute_groups(pairs(kept)) if k}

    clean = cp.decontamination(spark, one, SF)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert clean.columns == columns
    assert {i for i, _ in pairs(clean)} == {i for i, t in pairs(one) if not brute_hits(t, items)[1]}

    mixed = cp.mixture(spark, clean, SF)
    assert mixed.columns == columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = mixing.fit(clean, labels)
    high = {i for i, t in pairs(clean) if model.posteriors(t)[0] >= 0.55}
    assert high <= {i for i, _ in pairs(mixed)} <= {i for i, _ in pairs(clean)}

    out = sorted(map(tuple, cp.tokens(spark, mixed, SF).select("start", "doc_id", "n_tokens", "ids_crc32").collect()))
    lib, at, want = Tokenizer.from_file(tokenizer_path()), 0, []
    for i, t in sorted(pairs(mixed)):
        ids = np.array([*lib.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want.append((at, i, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert out == want


def test_stages_on_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "the word of it", "en", "s", 3), (3, "the word of it", "en", "s", 3), (None, "the house and it", "en", "s", 4), (None, None, None, None, None)], schema)
    for df in (odd, odd.limit(0)):
        for name, stage in cp.STAGES:
            df = stage(spark, df, SF)
            df.count()
            assert name == "tokens" or df.columns == odd.columns
    left = cp.near_duplicates(spark, odd, SF)
    assert left.filter("doc_id = 3").count() == 1 and left.filter("doc_id IS NULL").count() == 2
