"""A corpus, from documents to token shards: stages that each apply one operator to what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmap.llm import decontam, langid, mixing, neardup, token_shards
from strandmap.llm.common import row_key, small_or_as_is, stored, table
from strandmap.llm.queries import tokenizer_path

#: The mixture's target weights by domain: the high domain's tokens all stay, the others are thinned to their weights beside it.
#: A document at KEEP or better odds of being of the high domain is never thinned.
WEIGHTS = {"high": 0.90, "low": 0.08, "toxic": 0.02}
KEEP = 0.5


def _keyed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with a 128-bit key of each row's id and text, under names that no column has."""
    names = [next(n for n in (f"_k{i}{'_' * j}" for j in range(99)) if n not in docs.columns) for i in (0, 1)]
    return docs.withColumns(dict(zip(names, row_key(F.col("doc_id"), F.coalesce("text", F.lit(""))), strict=True))), names


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows of which ``gone`` has the key (r0, r1)."""
    keyed, names = _keyed(docs)
    gone = small_or_as_is(gone.select(F.col("r0").alias(names[0]), F.col("r1").alias(names[1])).distinct())
    return keyed.join(gone, names, "left_anti").select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier, learned from those that name one, accepts. Null and letterless texts go."""
    keys = F.struct(*[k.alias(f"r{i}") for i, k in enumerate(row_key(F.col("doc_id"), F.coalesce("text", F.lit(""))))])
    out = langid.identify(docs.select(keys.alias("k"), "text"), langid.fit(docs), "k")
    return _without(docs, stored(out.filter("rejected").select("k.r0", "k.r1"), "rejected"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id. Of rows that repeat an id with the same text one
    stays; those that repeat it with another text stay, and so do rows without an id.
    """
    found = neardup.near_duplicates(docs.select("doc_id", "text"))
    copies = small_or_as_is(found.filter(~F.col("kept")).select("doc_id"))
    left = docs.join(copies, "doc_id", "left_anti").select(*docs.columns)
    again = stored(left.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL").select("doc_id"), "again")
    if again.limit(1).count():
        again = small_or_as_is(again)
        one = left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
        left = left.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(one.select(*docs.columns))
    return left


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with a benchmark item."""
    found, _ = decontam.find_contamination(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return _without(docs, found.filter("contaminated"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents thinned by their rates: one stays if a hash of it, even over 0 to 1, is below its rate; at a rate of 1 or
    more, or a posterior of KEEP or more for the high domain, all do."""
    rates = mixing.mix(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), weights=WEIGHTS, whole="high")
    chance = F.shiftrightunsigned(F.xxhash64(F.lit("rate"), "r0", "r1"), 11) / float(1 << 53)
    return _without(docs, rates.filter((chance >= F.col("rate")) & (F.col("p")[mixing.DOMAINS.index("high")] < KEEP)))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id shards of what is left, read back through their indexes."""
    docs = docs.select("doc_id", "text")
    return token_shards.read_shards(token_shards.write_shards(docs, tokenizer_path()), docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture), ("tokens", tokens)]

#: Classifiers and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written to the shared folder before the next reads it."""
    df = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        df = stored(stage(spark, df, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, df, sf_dir)
