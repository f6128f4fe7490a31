"""Benchmark decontamination by winnowed word k-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, drop, row_key, small_or_as_is, stored

#: A run of WINDOW words holds WINDOW - GRAM + 1 grams, one of which is always selected.
WINDOW, GRAM = 10, 5
#: Low bits of a mark, which hold its position; a text has fewer than 2**31 words.
POS_BITS = 32
WORDS = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"


def words_of(text: Column) -> Column:
    """Words of a text with A-Z lower-cased: runs of digits, a-z and everything beyond ASCII; none if null."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORDS), F.lit(1))


def grams(words: Column, n: int) -> Column:
    """Hash of each run of n words; empty if there are fewer."""
    at = lambda i: F.xxhash64(*[F.get(words, i + F.lit(j)) for j in range(n)])
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), at)).otherwise(F.array().cast("array<long>"))


def with_selected(df: DataFrame, words: str, window: int, gram: int) -> DataFrame:
    """Adds ``marks``: the winnowed (gram hash, position) pairs, for texts of at least ``window`` words.

    The low bits of each hash give way to the position counted backwards, so that the least of a window is
    its least hash (of the bits left), the rightmost on ties: what is selected depends on the window's words alone.
    """
    low = (1 << POS_BITS) - 1
    span = window - gram + 1
    df = df.withColumn("_g", F.when(F.size(words) >= window, grams(F.col(words), gram)).otherwise(F.array().cast("array<long>")))
    mark = lambda h, i: h.bitwiseAND(F.lit(~low)).bitwiseOR(F.lit(low) - i.cast("long"))
    df = df.withColumn("_v", F.transform("_g", mark))
    v, n = F.col("_v"), F.size("_v")
    least = F.transform(F.sequence(F.lit(0), n - span), lambda i: F.least(*[F.get(v, i + F.lit(j)) for j in range(span)]) if span > 1 else F.get(v, i))
    df = df.withColumn("_m", F.when(n >= span, F.array_distinct(least)).otherwise(F.array().cast("array<long>")))
    at = lambda m: (F.lit(low) - m.bitwiseAND(F.lit(low))).cast("int")
    pair = lambda m: F.struct(F.get(F.col("_g"), at(m)).alias("hash"), at(m).alias("pos"))
    return df.withColumn("marks", F.transform("_m", pair)).drop("_g", "_v", "_m")


def windows_at(words: Column, starts: Column, length: Column) -> Column:
    """(start, length, w0, w1, own) of the windows at ``starts``: two hashes of the words and the words themselves."""

    def one(i: Column) -> Column:
        own = F.slice(words, i + 1, length)
        return F.struct(i.alias("start"), length.alias("length"), *[k.alias(f"w{j}") for j, k in enumerate(row_key(own))], own.alias("own"))

    return F.transform(starts, one)


def upto(n: Column) -> Column:
    """0 to n; empty if n is below 0."""
    return F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """Words of documents that lie in a run of ``window`` words of an item (an item of fewer words counts whole).

    Returns (totals, spans). totals has one row per input row: ``id_col``, r0, r1 (key of id and text), n_words,
    n_hit, n_items, items (ids as strings, sorted) and contaminated. spans has a row for each occurrence of a window:
    r0, r1, start, length, w0, w1 (hashes of its words). Null or empty texts have no words; items without words match
    nothing; equal items are all reported. The words of an item without an id count in n_hit and contaminated; n_items
    and items leave it out. Other columns are not read.

    Both sides are winnowed: every shared run of ``window`` words has a selected gram at the same place in both, so
    an equi-join with the items' selected grams loses none. A document's windows around such a gram then meet the
    items' distinct windows by hash, and words; the items of a window come in last, so what many items share is
    matched once. Items shorter than a window are looked up by all runs of their length. The items' tables are
    broadcast only if counts prove them small; otherwise the joins shuffle by hash, and adaptive execution splits a
    hot one.
    """
    item = items.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(item_text_col)).alias("iw")).filter(F.size("iw") > 0)
    item = stored(item, "items")
    lengths = sorted(r["n"] for r in item.select(F.size("iw").alias("n")).filter(F.col("n") < window).distinct().collect())
    length = F.least(F.size("iw"), F.lit(window))
    wins = item.select("item", F.explode(windows_at(F.col("iw"), upto(F.size("iw") - length), length)).alias("v")).select("item", "v.*")
    wins = stored(wins.select("item", "length", "w0", "w1", "own").distinct(), "windows")
    known = small_or_as_is(wins.select("length", "w0", "w1", "own").distinct())
    seeds = with_selected(item, "iw", window, gram).select(F.explode("marks").alias("m")).select(F.lit(0).alias("short"), "m.hash")
    for n in lengths:
        whole = item.filter(F.size("iw") == n).select(F.lit(n).alias("short"), F.get(grams(F.col("iw"), n), F.lit(0)).alias("hash"))
        seeds = seeds.unionByName(whole)
    seeds = stored(seeds.distinct().withColumn("seed", F.lit(True)), "seeds")

    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.select("id", "text", *[k.alias(f"r{i}") for i, k in enumerate(row_key(F.col("id"), F.col("text")))])
    marked = with_selected(base.withColumn("w", words_of(F.col("text"))), "w", window, gram)
    entry = lambda short, h, p: F.struct(F.lit(short).alias("short"), h.alias("hash"), p.alias("pos"))
    short_entry = lambda n: lambda h, i: entry(n, h, i)
    total = F.array(entry(-1, F.lit(0).cast("long"), F.size("w")))  # one row that carries the number of words
    parts = [total, F.transform("marks", lambda m: entry(0, m["hash"], m["pos"]))]
    parts += [F.transform(grams(F.col("w"), n), short_entry(n)) for n in lengths]
    marked = marked.select("id", "r0", "r1", F.explode(F.concat(*parts)).alias("e")).select("id", "r0", "r1", "e.*")
    hits = marked.join(small_or_as_is(seeds), ["short", "hash"], "left").filter((F.col("short") < 0) | F.col("seed"))
    hits = stored(hits.select("id", "r0", "r1", "short", "pos"), "hits")

    # The windows of a text around its hits, each once; as many as the text has words at most.
    near = hits.filter(F.col("short") >= 0).groupBy("r0", "r1").agg(F.collect_set(F.struct("short", "pos")).alias("at"))
    near = stored(near, "near")
    texts = base.select("r0", "r1", "text").join(near.select("r0", "r1"), ["r0", "r1"], "left_semi").dropDuplicates(["r0", "r1"])
    texts = texts.join(near, ["r0", "r1"]).withColumn("w", words_of(F.col("text")))
    last = F.size("w") - window
    around = F.transform(F.filter("at", lambda a: a["short"] == 0), lambda a: F.sequence(F.greatest(a["pos"] - (window - gram), F.lit(0)), F.least(a["pos"], last)))
    windows = [windows_at(F.col("w"), F.array_distinct(F.flatten(around)), F.lit(window))]
    of_length = lambda n: F.transform(F.filter("at", lambda a: a["short"] == n), lambda a: a["pos"])
    windows += [windows_at(F.col("w"), of_length(n), F.lit(n)) for n in lengths]
    met = texts.select("r0", "r1", F.explode(F.concat(*windows)).alias("v")).select("r0", "r1", "v.*")
    spans = stored(met.join(known, ["length", "w0", "w1", "own"]).select("r0", "r1", "start", "length", "w0", "w1"), "spans")

    places = spans.select("r0", "r1", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("p")).distinct()
    n_hit = places.groupBy("r0", "r1").agg(F.count("*").alias("n_hit"))
    of = small_or_as_is(wins.select("item", "length", "w0", "w1").distinct())
    which = spans.select("r0", "r1", "length", "w0", "w1").distinct().join(of, ["length", "w0", "w1"]).groupBy("r0", "r1").agg(F.sort_array(F.collect_set("item")).alias("items"))
    totals = hits.filter(F.col("short") < 0).select("id", "r0", "r1", F.col("pos").cast("long").alias("n_words"))
    totals = totals.join(n_hit.join(which, ["r0", "r1"]), ["r0", "r1"], "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    totals = totals.select(F.col("id").alias(id_col), "r0", "r1", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items_of).cast("long").alias("n_items"), items_of.alias("items"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))
    drop(seeds, item)
    return totals, spans
