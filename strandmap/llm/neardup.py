"""MinHash near-dedup: an inverted join of signature coordinates, with links confirmed on full shingle sets."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import drop, partitions, small_batches, small_or_as_is, stored
from .graph import components

COORDS, PERCENT, SHINGLE, MISS = 64, 85, 5, 1e-6
#: Rounds of comparing each text with one hub at most, before what is left is compared pair by pair.
HUB_ROUNDS = 2
#: Nodes of postings of DENSE nodes or more are compared in blocks of about BLOCK, COLUMNS shingles at a time.
DENSE, BLOCK, COLUMNS = 256, 256, 8192
#: Members of a hub that one run of rows holds.
RUN = 64


def match_threshold(coords: int, percent: int, miss: float) -> int:
    """The most coordinates to ask for so that a pair right at the similarity is missed at most so often."""
    p, below = percent / 100, 0.0
    for t in range(coords + 1):
        below += math.comb(coords, t) * p**t * (1 - p) ** (coords - t)
        if below > miss:
            return max(1, t)
    return coords


def _signer(coords: int, size: int, keep: bool = False):
    mult = np.random.default_rng(7).integers(1, 2**63, coords, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = tk.buffers(batch.column(1))
            n = batch.num_rows
            counts, halves, sigs = np.zeros(n, np.int64), np.zeros((n, 2), np.int64), np.zeros((n, coords), np.int32)
            for i, _, part, part_offs in tk.chunks(data, offs):
                sets = tk.shingle_sets(part, part_offs, size)
                some = [d for d, s in enumerate(sets) if len(s)]
                if not some:
                    continue
                for d in some:
                    counts[i + d] = len(sets[d])
                    halves[i + d] = np.frombuffer(hashlib.blake2b(sets[d].tobytes(), digest_size=16).digest(), np.int64)
                flat = np.concatenate([sets[d] for d in some])
                starts = np.concatenate([[0], np.cumsum([len(sets[d]) for d in some])[:-1]])
                rows = i + np.array(some)
                for c in range(coords):
                    top = ((flat * mult[c]) >> np.uint64(32)).astype(np.uint32)
                    sigs[rows, c] = np.minimum.reduceat(top, starts).view(np.int32)
            sig = pa.FixedSizeListArray.from_arrays(pa.array(sigs.reshape(-1)), coords).cast(pa.list_(pa.int32()))
            last = (batch.column(1), "text") if keep else (sig, "sig")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(halves[:, 0]), pa.array(halves[:, 1]), last[0]], ["id", "n", "c0", "c1", last[1]])

    return sign


def _comparer(percent: int, size: int):
    """Rows sorted by (hub, run) with the hub's own first: yields the links that hold on full sets."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hub_set = None, None
        for batch in batches:
            hubs, runs, nodes = (batch.column(k).to_pylist() for k in range(3))
            data, offs = tk.buffers(batch.column(3))
            links: list[tuple[int, int]] = []
            for i, _, part, part_offs in tk.chunks(data, offs):
                for d, own in enumerate(tk.shingle_sets(part, part_offs, size), i):
                    if (hubs[d], runs[d]) != at:
                        at, hub_set = (hubs[d], runs[d]), own
                        continue
                    if nodes[d] == hubs[d]:
                        continue
                    least, most = sorted((len(own), len(hub_set)))
                    if 100 * least < percent * most:
                        continue
                    both = len(np.intersect1d(own, hub_set, assume_unique=True))
                    if both and 100 * both >= percent * (len(own) + len(hub_set) - both):
                        links.append((hubs[d], nodes[d]))
            a, b = zip(*links, strict=True) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return compare


def _block_comparer(percent: int, size: int):
    """Two blocks of a dense group at a time: yields a spanning forest of the links between them (within, if one)."""

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        nodes, side = table.column("node").to_numpy(), table.column("side").to_numpy()
        data, offs = tk.buffers(table.column("text").combine_chunks())
        sets = [s for _, _, part, part_offs in tk.chunks(data, offs) for s in tk.shingle_sets(part, part_offs, size)]
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if (side == 1).any() else left
        n = np.array([len(s) for s in sets])
        flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
        _, col, held = np.unique(flat, return_inverse=True, return_counts=True)
        rank = np.cumsum(held > 1) - 1  # a shingle of one node is in no intersection
        keep = held[col] > 1
        row, col = of[keep], rank[col[keep]]
        both = np.zeros((len(left), len(right)), np.float32)
        for lo in range(0, int(col.max()) + 1 if len(col) else 0, COLUMNS):
            here = (col >= lo) & (col < lo + COLUMNS)
            m = np.zeros((len(sets), COLUMNS), np.float32)
            m[row[here], col[here] - lo] = 1
            both += m[left] @ m[right].T
        linked = 100 * both >= percent * (n[left][:, None] + n[right][None, :] - both)
        root = list(range(len(sets)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        links = []
        for i, j in zip(*(k.tolist() for k in np.nonzero(linked)), strict=True):
            i, j = int(left[i]), int(right[j])
            a, b = find(i), find(j)
            if a != b:
                root[a] = b
                links.append((nodes[i], nodes[j]))
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return compare


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, coords: int = COORDS, size: int = SHINGLE, miss: float = MISS) -> DataFrame:
    r"""Groups of near copies: one row per input row with ``id_col`` (long), n_shingles, component_id and kept.

    Words are runs of other than ``[\x20\x09-\x0D]`` with A-Z lower-cased; a document's set holds its distinct
    ``size``-word shingles (all words as one if fewer). Documents are linked if 100 * intersection >= percent *
    union. component_id is the smallest id reachable over links, kept is id = component_id. Documents without
    words (null, empty or blank) are linked with nothing. Rows of one id are linked with each other, whatever their
    texts; a null id is linked with nothing, has a null component and is kept. Other columns are not read.

    Equal sets become one node first, so copies never meet in pairs; a node bears the smallest id that holds its set, or
    a hash of the set if that id has other sets besides. Each node posts its MinHash coordinates; those
    that another node shares, rarest first, form its prefix, long enough that two nodes with ``t`` coordinates
    in common meet in a prefix posting (t: a pair at the threshold falls short once in 1/miss). Nodes of a
    posting are not paired with each other: every round compares each with one hub, components are contracted, and
    only pairs between different components are left; once these are few (or after HUB_ROUNDS) all of them are
    compared: pair by pair, but for nodes that large postings tie together, of which two blocks at a time are compared
    by a product of their incidence matrices, which yields links alone. Links are decided on the full shingle sets.
    """
    spark = docs.sparkSession
    small_batches(spark)
    t = match_threshold(coords, percent, miss)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = stored(base.mapInArrow(_signer(coords, size), "id long, n long, c0 long, c1 long, sig array<int>"), "signed")
    full = signed.filter((F.col("n") > 0) & F.col("id").isNotNull())
    nodes = full.groupBy("c0", "c1").agg(F.min("id").alias("node"), F.count("*").alias("copies"), F.min("sig").alias("sig"))
    several = signed.filter(F.col("id").isNotNull()).groupBy("id").agg(F.min(F.struct("c0", "c1")).alias("lo"), F.max(F.struct("c0", "c1")).alias("hi")).filter("lo <> hi").select("id")
    several = stored(several, "several")  # ids that hold more than one set, or one and no words
    of_ids = several.limit(1).count() > 0
    if of_ids:
        other = F.xxhash64(F.lit("set"), "c0", "c1").bitwiseOR(F.lit(-(2**63)))  # below 0
        nodes = nodes.join(small_or_as_is(several.select(F.col("id").alias("node"), F.lit(True).alias("own"))), "node", "left")
        nodes = nodes.select("c0", "c1", F.when(F.col("own"), other).otherwise(F.col("node")).alias("node"), "copies", "sig", F.coalesce("own", F.lit(False)).alias("own"))
    nodes = stored(nodes, "nodes")

    token = F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("v").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    tokens = nodes.select("node", F.posexplode("sig").alias("pos", "v")).select("node", token.alias("tok"))
    shared = stored(tokens.groupBy("tok").count().filter("count > 1"), "shared")  # a table, so that a join with a common token can be split
    ranked = tokens.join(shared, "tok").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("count", "tok"))).alias("ranked")).filter(F.size("ranked") >= t)
    toks = F.transform("ranked", lambda x: x["tok"])
    held = stored(ranked.select("node", toks.alias("toks"), F.slice(toks, F.lit(1), F.size("ranked") - t + 1).alias("prefix")), "held")
    postings = stored(held.select("node", F.explode("prefix").alias("tok")), "postings")
    n_postings = postings.count()
    texts, labels = None, None
    spent = [shared, held, postings, several]

    def labelled(df: DataFrame) -> DataFrame:
        if labels is None:
            return df.withColumn("label", F.col("node"))
        return df.join(small_or_as_is(labels), "node", "left").withColumn("label", F.coalesce("label", "node"))

    def text_of_nodes() -> DataFrame:
        """Texts of the nodes that share a posting: only these can ever be compared."""
        nonlocal texts
        if texts is None:
            ids = postings.select(F.col("node").alias("id")).distinct()
            texts = base.join(small_or_as_is(ids), "id", "left_semi").dropDuplicates(["id"])
            if of_ids:
                sets = base.join(small_or_as_is(several), "id", "left_semi").mapInArrow(_signer(coords, size, True), "id long, n long, c0 long, c1 long, text string")
                own = nodes.filter("own").select("c0", "c1", F.col("node").alias("id")).join(ids, "id", "left_semi")
                texts = texts.unionByName(sets.dropDuplicates(["c0", "c1"]).select("c0", "c1", "text").join(own, ["c0", "c1"]).select("id", "text"))
            texts = stored(texts, "texts")
            spent.append(texts)
        return texts.select(F.col("id").alias("node"), "text")

    def dense_links(post: DataFrame, large: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Links between nodes that large postings tie together, and the group (node, g) of each of these."""
        ties = post.join(small_or_as_is(large.select("tok")), "tok").select(F.col("node").alias("a"), F.xxhash64(F.lit("tok"), "tok").alias("b"))
        found = components(ties)
        group = stored(post.select("node").distinct().join(found.select(F.col("v").alias("node"), F.col("c").alias("g")), "node"), "dense")
        blocks = group.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        dealt = group.join(small_or_as_is(blocks), "g").select("node", "g", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        dealt = dealt.select("node", "g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))
        dealt = dealt.join(text_of_nodes(), "node")
        return dealt.groupBy("g", "i", "j").applyInArrow(_block_comparer(percent, size), "a long, b long"), group

    def links_of(pairs: DataFrame) -> DataFrame:
        """Pairs (a: hub, b) whose sets are alike enough; each text moves once a pair, the hub's once a run of RUN members."""
        runs = stored(pairs.groupBy("a").agg(F.ceil(F.count("*") / RUN).cast("int").alias("runs")), "runs")  # so that a large hub's join can be split
        spent.append(runs)
        run = F.pmod(F.xxhash64("b"), F.col("runs")).cast("int")
        members = pairs.join(runs, "a").select(F.col("a").alias("hub"), run.alias("run"), F.col("b").alias("node"))
        own = runs.select(F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run"), F.col("a").alias("node"))
        dealt = members.unionByName(own).join(text_of_nodes(), "node").select("hub", "run", "node", "text")
        dealt = dealt.repartition(partitions(spark), "hub", "run").sortWithinPartitions("hub", "run", F.col("node") != F.col("hub"))
        return dealt.mapInArrow(_comparer(percent, size), "a long, b long")

    def contract(links: DataFrame) -> None:
        nonlocal labels
        links = stored(links, "links")
        spent.append(links)
        if labels is not None:
            now = small_or_as_is(labels)
            links = links.join(now.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left").join(now.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
            links = links.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).filter("a <> b")
        found = components(links)
        if labels is not None:
            moved = labels.join(found.select(F.col("v").alias("label"), "c"), "label", "left").select("node", F.coalesce("c", "label").alias("label"))
            fresh = found.join(labels.select(F.col("node").alias("v")), "v", "left_anti").select(F.col("v").alias("node"), F.col("c").alias("label"))
            found = moved.union(fresh)
        else:
            found = found.select(F.col("v").alias("node"), F.col("c").alias("label"))
        labels = stored(found, "components")
        spent.append(labels)

    if of_ids:
        held_by = full.join(small_or_as_is(several), "id").join(nodes.select("c0", "c1", "node"), ["c0", "c1"]).select("id", "node").distinct()
        held_by = stored(held_by, "held-by")
        least = held_by.groupBy("id").agg(F.min("node").alias("a"))
        contract(held_by.join(least, "id").filter("a <> node").select("a", F.col("node").alias("b")))
    for r in range(HUB_ROUNDS + 1):
        post = labelled(postings)
        sizes = post.groupBy("tok", "label").count().groupBy("tok").agg(F.sum("count").alias("m"), F.sum(F.col("count") * F.col("count")).alias("own"), F.count("*").alias("labels")).filter("labels > 1")
        left = sizes.agg(F.sum((F.col("m") * F.col("m") - F.col("own")) / 2)).head()[0] or 0
        if not left:
            break
        if r == HUB_ROUNDS or left <= n_postings:
            sizes = stored(sizes, "sizes")
            spent.append(sizes)
            large, links, apart = sizes.filter(F.col("m") >= DENSE), None, F.lit(True)
            whole = post.join(sizes.filter(F.col("m") < DENSE).select("tok"), "tok").join(held, "node")
            if large.limit(1).count():  # all nodes that a large posting holds are in one group, and compared there
                links, group = dense_links(post, large)
                spent.append(group)
                whole = whole.join(small_or_as_is(group), "node", "left")
                apart = ~F.coalesce(F.col("a.g") == F.col("b.g"), F.lit(False))
            a, b = whole.alias("a"), whole.alias("b")
            first = F.array_min(F.array_intersect("a.prefix", "b.prefix")) == F.col("a.tok")
            enough = F.size(F.array_intersect("a.toks", "b.toks")) >= t
            pairs = a.join(b, (F.col("a.tok") == F.col("b.tok")) & (F.col("a.label") != F.col("b.label")) & (F.col("a.node") < F.col("b.node")) & apart & first & enough)
            pairs = stored(pairs.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")), "pairs")
            spent.append(pairs)
            contract(links_of(pairs) if links is None else links_of(pairs).union(links))
            break
        hubs = post.groupBy("tok").agg(F.min(F.struct(F.xxhash64(F.lit(r), "node").alias("h"), F.col("node").alias("a"), F.col("label").alias("la"))).alias("hub"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("tok", "hub.a", "hub.la")
        hubs = stored(hubs, "hubs")  # so that the join with a common token can be split
        spent.append(hubs)
        met = post.join(hubs, "tok").filter("label <> la").groupBy("a", F.col("node").alias("b")).count()
        met = met.join(held.select(F.col("node").alias("b"), F.col("toks").alias("tb")), "b").join(held.select(F.col("node").alias("a"), F.col("toks").alias("ta")), "a")
        common = F.size(F.array_intersect("ta", "tb"))
        best = met.select("a", "b", common.alias("common")).filter(F.col("common") >= t).groupBy("b").agg(F.max(F.struct("common", "a")).alias("best")).select("best.a", "b")
        best = stored(best, "pairs")
        spent.append(best)
        contract(links_of(best))

    copies = nodes.filter(F.col("own") | (F.col("copies") > 1) if of_ids else F.col("copies") > 1).select("c0", "c1", "node")
    out = signed.join(copies, ["c0", "c1"], "left")
    node = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.coalesce("node", "id")).otherwise(F.col("id"))
    out = out.select("id", "n", node.alias("node"))
    if labels is not None:
        out = out.join(labels.filter("label <> node"), "node", "left").withColumn("node", F.coalesce("label", "node"))
    if of_ids:  # components of such ids, for their rows without words too, and by the smallest id
        at = held_by.join(labels, "node", "left").groupBy("id").agg(F.min(F.coalesce("label", "node")).alias("at"))
        out = stored(out.join(small_or_as_is(at), "id", "left").select("id", "n", F.coalesce("at", "node").alias("node")), "components")
        least = out.groupBy("node").agg(F.min("id").alias("least"))
        spent += [out, held_by]
        out = out.join(least, "node", "left").select("id", "n", F.coalesce("least", "node").alias("node"))
    out = stored(out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("node").alias("component_id"), F.coalesce(F.col("id") == F.col("node"), F.lit(True)).alias("kept")), "groups")
    drop(signed, nodes, *spent)
    return out
