"""Each corpus operator against a brute-force version, and on the cases that break joins and kernels."""

import hashlib
import random
import textwrap
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmap.llm import decontam, files, fingerprints, langid, licences, line_dedup, mixing, mphf, neardup, pieces, quality, sampling, token_shards, warc
from strandmap.llm.queries import tokenizer_path

DOC = "doc_id long, text string, id string, r0 string, w int, node int, label string, hash int"


def docs_of(spark, rows, parts=3):
    """Documents with other columns whose names the operators use within."""
    full = [(i, t, "x", "y", 1, 2, "z", 3) for i, t in rows]
    return spark.createDataFrame(full, DOC).repartition(parts) if full else spark.createDataFrame([], DOC)


LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ODD = [(1, None), (2, ""), (3, "  \t "), (4, LONG), (5, LONG), (6, "one"), (6, "one"), (None, "nobody's text"), (None, None), (7, "ünïcödé 中文 \U0001f600 words")]


def by_id(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


# Line dedup


def brute_lines(rows, least, many):
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate({c: c + 32 for c in range(65, 91)})
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least and i is not None:
                held[key(x)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held[key(x)]) >= many and i != max(held[key(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_lines(spark):
    r = random.Random(1)
    some = ["a long common line " + c for c in "abcdef"] + ["Short", "", "  A LONG common line a ", "x" * 25]
    rows = [(i, "\n".join(r.choice(some) for _ in range(r.randint(0, 8)))) for i in range(40)] + ODD
    got = line_dedup.dedup_lines(docs_of(spark, rows))
    assert by_id(got, "doc_id", "n_lines", "n_dropped", "kept_text") == brute_lines(rows, 20, 3)
    assert line_dedup.dedup_lines(docs_of(spark, [])).count() == 0


# Decontamination


def brute_hits(text, items):
    word = lambda t: [x for x in "".join(c.lower() if "A" <= c <= "Z" else c if c.isdigit() and c < "\x80" or "a" <= c <= "z" or c > "\x7f" else " " for c in t or "").split(" ") if x]
    w, hit, found = word(text), set(), set()
    for k, item in items:
        v = word(item)
        n = min(10, len(v))
        wins = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                found |= {str(k)} - {"None"}
    return len(w), len(hit), sorted(found)


def test_contamination(spark):
    r = random.Random(2)
    words = ["ab", "Cd", "e1", "ñu", "zz", "q"]
    say = lambda n: r.choice([" ", ", ", "\n"]).join(r.choice(words) for _ in range(n))
    items = [(k, say(r.choice([3, 5, 9, 10, 11, 25]))) for k in range(12)] + [(90, ""), (91, None), (92, "same item words here to be found twice over now then"), (93, "same item words here to be found twice over now then"), (None, "an item that has no id but has more than ten words"), (None, "no id")]
    items += [(100 + k, f"a very common passage of five words {k} {say(12)}") for k in range(6)]
    rows = [(300 + k, f"{say(3)} a very common passage of five words {k} {say(k)}") for k in range(8)]
    rows += [(400, "An item that has no id but has more than ten words."), (401, "no no id")]
    for i in range(60):
        extra = r.choice(items)[1] or ""
        rows.append((i, f"{say(r.randint(0, 30))} {extra.upper() if i % 2 else ''} {say(4)}"))
    rows += ODD
    got, spans = decontam.find_contamination(docs_of(spark, rows), spark.createDataFrame(items, "item_id int, text string"))
    want = sorted([(i, *brute_hits(t, items)[:2], brute_hits(t, items)[2]) for i, t in rows], key=str)
    assert by_id(got, "doc_id", "n_words", "n_hit", "items") == want
    assert spans.count() > 0
    none, _ = decontam.find_contamination(docs_of(spark, rows), spark.createDataFrame([], "item_id int, text string"))
    assert none.filter("contaminated").count() == 0 and none.count() == len(rows)
    assert decontam.find_contamination(docs_of(spark, []), spark.createDataFrame(items, "item_id int, text string"))[0].count() == 0


# Near duplicates


def shingles(t):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").split(" ")
    w = [x for x in w if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_groups(rows):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [i for i in sets if i is not None]
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 85 * len(x | y) for x in sets[a] for y in sets[b]):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return sorted([(i, len(shingles(t)), None if i is None else find(i), i is None or find(i) == i) for i, t in rows], key=str)


def near_rows(seed, groups, size):
    r = random.Random(seed)
    rows, i = [], 0
    for g in range(groups):
        base = [f"w{r.randrange(5000)}" for _ in range(r.randint(60, 160))]
        for _ in range(size):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 4])):
                t[r.randrange(len(t))] = f"edit{r.randrange(10**6)}"
            rows.append((i, " ".join(t)))
            i += 1
    r.shuffle(rows)
    return rows


def test_near_duplicates(spark):
    rows = [(i + 100, t) for i, t in near_rows(3, 8, 12)] + [(i, t) for i, t in ODD if i != 6] + [(6, "one"), (6, "one"), (8, "One"), (9, "Two Words"), (10, "two  words")]
    got = neardup.near_duplicates(docs_of(spark, rows))
    assert by_id(got, "doc_id", "n_shingles", "component_id", "kept") == brute_groups(rows)
    assert neardup.near_duplicates(docs_of(spark, [])).count() == 0


def test_near_duplicates_of_ids_with_several_texts(spark):
    say = lambda c: " ".join(f"{c}{i}" for i in range(100))
    rows = [(1, say("a")), (1, say("b")), (2, say("a") + " more"), (3, say("b") + " more")]
    assert {r["component_id"] for r in neardup.near_duplicates(docs_of(spark, rows)).collect()} == {1}
    r = random.Random(5)
    rows = near_rows(11, 8, 4)
    rows = [(i, t) for i, t in rows if i % 3] + [(r.randrange(32), t) for _, t in rows[:14]] + [(1, ""), (5, None), (7, say("c")), (9, say("c")), (9, ""), (None, say("c")), *ODD]
    got = neardup.near_duplicates(docs_of(spark, rows))
    assert by_id(got, "doc_id", "n_shingles", "component_id", "kept") == brute_groups(rows)


def test_near_duplicates_in_dense_groups(spark, monkeypatch):
    rows = near_rows(4, 2, 90)
    want = brute_groups(rows)
    for dense, block, rounds in ((10, 16, 1), (10**6, 16, 1), (10, 1000, 0)):
        monkeypatch.setattr(neardup, "DENSE", dense)
        monkeypatch.setattr(neardup, "BLOCK", block)
        monkeypatch.setattr(neardup, "HUB_ROUNDS", rounds)
        got = neardup.near_duplicates(docs_of(spark, rows, 5))
        assert by_id(got, "doc_id", "n_shingles", "component_id", "kept") == want


def test_match_threshold():
    t = neardup.match_threshold(64, 85, 1e-6)
    assert 30 < t < 45 and neardup.match_threshold(64, 85, 1e-2) > t


# Fingerprints


def test_fingerprints(spark):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(r.randint(0, 400)))) for i in range(50)] + [(60, None), (61, ""), (62, "x"), (63, LONG), (64, LONG), (70, "ünï \U0001f600中")]
    rows.sort()
    got = {x["doc_id"]: x for x in fingerprints.fingerprint_with_edits(docs_of(spark, rows)).collect()}
    assert len(got) == len(rows)
    back = rows[::-1]
    for k, (i, t) in enumerate(back):
        t, nxt = t or "", back[(k + 1) % len(back)][1] or ""
        m = len(t) // 3
        edited = t[: len(t) - m] + nxt[:m]
        assert (got[i]["n_chars"], got[i]["edited"]) == (len(t), edited)
        for col, other in (("near_edited", edited), ("near_next", nxt)):
            a, b = shingles(t), shingles(other)
            exact = len(a & b) / len(a | b) if a | b else 1.0
            assert got[i][col] == pytest.approx(exact, abs=1e-9 if len(a | b) < 256 else 0.12)
    assert got[63]["sketch"] == got[64]["sketch"] and got[60]["sketch"] == [] and len(got[63]["sketch"]) == 256


def test_sketch_merging_and_estimates(spark):
    parts = [" ".join(f"p{k}w{i}" for i in range(700)) for k in range(3)]
    df = spark.createDataFrame([("g", p, i) for i, p in enumerate(parts)] + [("h", None, 9)], "k string, text string, n int")
    df = fingerprints.with_sketch(df, "text", "s")
    m = {r["k"]: r for r in fingerprints.merge_by(df, ["k"], "s", fan=2).select("k", "s", fingerprints.distinct_count(F.col("s")).alias("n")).collect()}
    assert m["g"]["n"] == pytest.approx(3 * 696, rel=0.15) and m["h"]["s"] == []
    both = df.filter("n = 0").select(F.col("s").alias("a")).crossJoin(fingerprints.merge_by(df.filter("k = 'g'"), ["k"], "s").select(F.col("s").alias("b")))
    r = both.select(fingerprints.containment(F.col("a"), F.col("b")).alias("c"), fingerprints.resemblance(F.col("a"), F.col("b")).alias("j")).head()
    assert r["c"] == pytest.approx(1, abs=0.2) and r["j"] == pytest.approx(1 / 3, abs=0.1)


# Token shards


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 20_000))
    h = mphf.PerfectHash.build(keys)
    assert (np.sort(h(keys)) == np.arange(len(keys))).all()
    assert len(h.bits) * 64 < 8 * len(keys)
    with pytest.raises(ValueError):
        mphf.PerfectHash.build(np.array([5, 5]))
    assert len(mphf.PerfectHash.build(np.zeros(0, np.int64))(np.array([1]))) == 1


def test_pieces_are_the_librarys():
    from tokenizers import Tokenizer

    enc, lib = token_shards.Encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    assert enc.by_piece
    r = random.Random(6)
    signs = list("aAszt'’ \n\t\r,.!?12٣é中😀  '\"ll re've'd'm  <|endoftext|>\x00\x1c ​ ß½ñ́\x85")
    for _ in range(60):
        texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 40))) for _ in range(r.randint(1, 30))] + ["", "it's we'll they'vex ''s 's\n's", "   ", "\n\n b", "<|endoftext|>", "x <|endoftext|> y", "<|endof", "text|>"]
        ids, n = enc(texts)
        ends = np.cumsum(n)
        assert [list(x) for x in np.split(ids, ends[:-1])] == [[*lib.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    table = pieces.Table(4)
    h = np.arange(1, 12, dtype=np.uint64) * np.uint64(16)  # all fall on one slot
    table.add(h, h)
    assert list(table.find(h, h)) == list(range(11)) and list(table.find(h, h + np.uint64(1))) == [-1] * 11


def test_token_shards(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_shards, "CACHED", 50)
    lib = Tokenizer.from_file(tokenizer_path())
    rows = [(i * 7 % 101, f"text number {i} " * (i % 5)) for i in range(101)] + [(300, "x <|endoftext|> y")] + ODD
    manifest = token_shards.write_shards(docs_of(spark, rows), tokenizer_path(), shards=4)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_shards.read_shards(manifest, docs_of(spark, rows)).collect())
    at, want = 0, []
    for i, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((at, i, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    shard = token_shards.Shard(manifest.orderBy("shard").collect()[-1]["path"])
    row, run = shard.find(np.array([300, 10**9]))
    assert (row[0], run[0], run[1]) == (len(shard.offsets) - 2, 1, 0)
    assert list(shard.tokens(row[0])) == [*lib.encode("x <|endoftext|> y", add_special_tokens=False).ids, 0]
    few = token_shards.read_shards(manifest, docs_of(spark, [(6, ""), (300, "")]))  # by key alone
    assert by_id(few, "start", "doc_id", "n_tokens", "ids_crc32") == sorted((w for w in want if w[1] in (6, 300)), key=str)
    with pytest.raises(Exception, match="no key 7000"):
        token_shards.read_shards(manifest, docs_of(spark, [(7000, "")])).collect()
    none = docs_of(spark, [])
    assert token_shards.read_shards(token_shards.write_shards(none, tokenizer_path()), none).count() == 0


# WARC


def test_warc_rejects_what_payloads_hold(spark):
    inner = warc.record(77, "http://fake", b"fake", None, "1970-01-01T00:00:00Z").decode()
    rows = [(i, f"http://h/{i} x", f"<p>{i % 7}</p>" * (i % 7) + inner * (i % 3)) for i in range(60)] + [(100, None, None), (101, "u", ""), (102, "é\n", "WARC/1.0\r\n"), (103, "u", "x" * 100_000), (104, "u", "x" * 100_000), (104, "u", "x" * 100_000), (None, "u", "x" * 100_000), (None, "u", "alone")]
    pages = spark.createDataFrame([(a, b, c, 1, "z") for a, b, c in rows], "page_id long, url string, html string, first int, sha1 string").repartition(4)
    first = {}
    for i, _, t in rows:
        p = (t or "").encode()
        if i is not None:
            first[p] = min(first.get(p, i), i)
    want = []
    for i, _, t in rows:
        p = (t or "").encode()
        f = first.get(p)
        again = f is not None and i != f
        want.append((i, len(p), warc.base32_sha1(p), "revisit" if again else "response", f if again else None))
    manifest = warc.write_warc(pages)
    for chunk in (300, 4 << 20):
        got = warc.read_warc(manifest, chunk)
        assert by_id(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=str)
    kept = {r["page_id"]: r["payload"] for r in warc.read_warc(manifest, payload=True).filter("record_type = 'response'").collect()}
    assert kept[102] == "WARC/1.0\r\n" and kept[103] == "x" * 100_000
    small = warc.read_warc(warc.write_warc(pages, min_bytes=50)).filter("payload_bytes < 50 AND record_type = 'revisit'")
    assert small.count() == 0
    assert warc.read_warc(warc.write_warc(pages.limit(0))).count() == 0


def test_warc_notices_a_broken_chain(spark):
    pages = spark.createDataFrame([(1, "u", "abc"), (2, "u", "def")], "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_warc(pages)
    r = manifest.head()
    where, path = files.open_fs(r["path"])
    data = files.read_all(r["path"])
    with where.open_output_stream(path) as f:
        f.write(data[:-10] + b"garbage.....")
    with pytest.raises(ValueError, match="chain"):
        warc.read_warc(spark.createDataFrame([(r["path"], len(data) + 2, 2)], manifest.schema))


def test_samples_are_bounded_before_they_are_collected(spark):
    hot = spark.range(100_000).select(F.col("id"), F.lit("the same text").alias("text"), F.lit("en").alias("y"))
    rest = spark.range(3000).select((F.col("id") + 10**6).alias("id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("y"))
    few = spark.createDataFrame([(1, "un", "fr"), (2, "un", "fr"), (3, None, "fr"), (4, "x", None), (5, "z" * 2000, "fr")], "id long, text string, y string")
    docs = hot.unionByName(rest).unionByName(few)
    rows, counts = sampling.labelled_sample(docs, None, 500, longest=1000)
    got = rows.collect()
    assert counts == {"en": 103_000, "fr": 3}
    assert sum(r["y"] == "en" for r in got) == 500 and sorted(r["text"] for r in got if r["y"] == "fr") == ["", "un"]
    assert len({(r["text"], r["y"]) for r in got}) == len(got)
    assert sampling.in_order(got) == sampling.in_order(sampling.labelled_sample(docs.repartition(7), None, 500, longest=1000)[0].collect())
    assert sum(len(r["text"]) for r in sampling.labelled_sample(docs, None, 500, most_bytes=300)[0].collect() if r["y"] == "en") <= 300
    marks = docs.select((F.col("id") % 50).alias("id"), "y")  # ids that repeat
    rows, _ = sampling.labelled_sample(docs.select("id", "text"), marks, 20)
    got = rows.collect()
    assert 0 < len(got) <= 40 and sum(r["y"] == "en" for r in got) <= 20
    assert sampling.fitted(rows, len) == len(got) and sampling.fitted(rows.limit(0), len) == 0


# Licences


def test_licences(spark):
    m = licences.train()
    prose = "The hills are green.\nHe went to the market and paid."
    rows = [(10 + k, f"{prose}\n{t}\n{prose}") for k, t in enumerate(t for f in sorted(licences.TEMPLATES) for t in licences.TEMPLATES[f])] + [(200, prose), (201, "A driving license is required."), *ODD]
    want = []
    for i, t in rows:
        known, at, other = set(), [], 0
        for k, p in enumerate((t or "").split("\n")):
            q = m.probabilities(p)
            name = m.families[q.argmax()]
            if name == licences.UNKNOWN:
                continue
            g = set(licences.grams(p))
            like = max(len(g & set(licences.grams(x))) / len(set(licences.grams(x))) for x in licences.TEMPLATES[name])
            if q.max() >= m.least and like >= licences.CONFIRM:
                known.add(name)
                at.append(k)
            else:
                other += 1
        want.append((i, len(at), other, ",".join(sorted(known)), at))
    got = licences.by_document(docs_of(spark, rows), m)
    assert by_id(got, "doc_id", "n_licences", "n_unknown", "families", "positions") == sorted(want, key=str)
    right = sum(r["families"] == f for (f, r) in zip([f for f in sorted(licences.TEMPLATES) for _ in licences.TEMPLATES[f]], sorted((r for r in got.collect() if r["doc_id"] and 10 <= r["doc_id"] < 200), key=lambda r: r["doc_id"]), strict=True))
    assert right >= 0.9 * sum(map(len, licences.TEMPLATES.values()))
    assert {r["doc_id"]: r["n_licences"] for r in got.collect()}[201] == 0
    assert licences.by_document(docs_of(spark, []), m).count() == 0


# Classifiers


SF = "/root/testdata/sf0.01"


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = langid.fit(docs, held_out=held)
    out = langid.identify(docs, model).join(docs.filter(held).select("doc_id", "lang"), "doc_id")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).head()[0] > 0.97
    assert out.filter("rejected").count() <= 0.01 * out.count()
    got = by_id(langid.identify(docs_of(spark, [*ODD, (20, "12 :: 34")]), model), "doc_id", "lang_pred")
    assert [x for x in got if x[1] == "und"] == [(1, "und"), (2, "und"), (20, "und"), (3, "und"), (None, "und")]
    blank = langid.fit(docs.limit(0))
    assert {r[0] for r in langid.identify(docs_of(spark, [(1, "some text")]), blank).select("lang_pred").collect()} == {"und"}
    assert langid.identify(docs_of(spark, []), model).count() == 0


def test_quality(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = quality.fit(docs, labels, held_out=held)
    out = quality.score(docs, model).join(labels.filter(held), "doc_id")
    assert out.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).head()[0] > 0.9
    got = quality.score(docs_of(spark, ODD), model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    flat = quality.fit(docs, labels.limit(0))
    assert quality.score(docs_of(spark, [(1, "some text")]), flat).head()["score"] == 0.5
    assert quality.score(docs_of(spark, []), model).count() == 0


def test_fast_scores_are_the_networks():
    texts = [("good prose here. " * 5, 1), ("### $$$ *** bad", 0)] * 10
    m = quality.train(texts)
    data, offs = quality.joined([t for t, _ in texts] + ["", "x"])
    z = m.logits(m.pooled(data, offs)) / m.heat
    assert m.score(data, offs) == pytest.approx(1 / (1 + np.exp(z[:, 0] - z[:, 1])), abs=1e-5)


# Mixing


def test_mixing(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = mixing.fit(docs, labels)
    out = mixing.mix(docs, labels, model=model).cache()
    total = out.agg(F.sum("n_tokens")).head()[0]
    sums = out.agg(*[F.sum(F.col("n_tokens") * F.col("rate") * F.col("p")[j]).alias(d) for j, d in enumerate(mixing.DOMAINS)], F.min("rate").alias("least")).head()
    assert sums["least"] >= 0
    for d in mixing.DOMAINS:
        assert sums[d] / total == pytest.approx(mixing.WEIGHTS[d], abs=1e-4)
    got = {r["doc_id"]: r for r in out.collect()}
    for r in docs.limit(20).collect():
        assert got[r["doc_id"]]["p"] == pytest.approx(list(model.posteriors(r["text"])), abs=1e-6)
        assert got[r["doc_id"]]["n_tokens"] == len(mixing.python_features(r["text"])[0])
    odd = mixing.mix(docs_of(spark, ODD), labels, model=model)
    assert odd.count() == len(ODD) and odd.filter("rate < 0 OR rate IS NULL").count() == 0
    assert mixing.mix(docs_of(spark, []), labels.limit(0)).count() == 0
    # targets that some domain can't reach end in least squares, not in a failure
    assert mixing.mix(docs.limit(50), labels, {"high": 0.0, "low": 0.0, "toxic": 1.0}, model=model).filter("rate < 0").count() == 0


# Digests of whole queries


def test_query_digests(spark):
    from strandmap.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in QUERIES["op10_fingerprints"](spark, sf).collect()}
    order = sorted(docs, reverse=True)
    for k, i in enumerate(order[:30]):
        t, nxt = docs[i], docs[order[(k + 1) % len(order)]]
        m = len(t) // 3
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - m] + nxt[:m]).encode()).hexdigest()
    assert {k.split("_")[0] for k in QUERIES} == {f"op{n}" for n in range(1, 11)}


def test_licences_of_wrapped_and_cut_notices(spark):
    m = licences.train()
    all_templates = [(f, t) for f in sorted(licences.TEMPLATES) for t in licences.TEMPLATES[f]]
    prose = "The hills are green.\nHe went to the market and paid.\n"
    rows = [(10 + k, prose + "\n" * (k % 2) + "\n".join(textwrap.wrap(t, 76)) + "\n" + prose) for k, (_, t) in enumerate(all_templates)]
    rows += [(100 + k, "\n".join(textwrap.wrap(t, 40, initial_indent="# ", subsequent_indent="# "))) for k, (_, t) in enumerate(all_templates)]
    cut = "Hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."
    mit, bsd = licences.TEMPLATES["mit"][0], licences.TEMPLATES["bsd"][0]
    rows += [(500, cut), (501, mit + "\n" + "\n".join(textwrap.wrap(bsd, 76))), (502, f"{prose}\n{bsd}\n\n{prose}")]
    got = {r["doc_id"]: r for r in licences.by_document(docs_of(spark, rows), m).collect()}
    wrong = [(i, f, got[i]["families"]) for k, (f, _) in enumerate(all_templates) for i in (10 + k, 100 + k) if f not in got[i]["families"].split(",")]
    assert not wrong
    assert got[500]["families"] == "mit" and got[501]["families"] == "bsd,mit"
    assert (got[502]["n_licences"], got[502]["positions"]) == (1, [3])
    lines = licences.scan(docs_of(spark, rows), m).filter("doc_id = 501").collect()
    assert sorted((r["pos"], r["lines"], r["family"]) for r in lines if r["family"] != licences.UNKNOWN)[0] == (0, 1, "mit")


def test_licences_pass_over_only_what_is_unknown():
    m = licences.train()
    assert all(g in m.features for some in licences.TEMPLATES.values() for t in some for g in licences.grams(t))
    assert m.held_back["accuracy"] > 0.95 and m.held_back["precision"] >= 0.98 and m.held_back["left out"] <= 0.02
    r = random.Random(3)
    bits = [g for g in m.features if licences.weak(g)]
    for _ in range(3000):
        p = " ".join(r.choice([r.choice(bits), "0x", "zzz"]) for _ in range(r.randint(1, 40)))
        if not set(m.strong()) & set(licences.grams(p)):
            assert m.families[m.probabilities(p).argmax()] == licences.UNKNOWN
