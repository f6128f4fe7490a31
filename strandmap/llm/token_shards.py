"""Token-id shards: raw id payloads in ascending key order, each with a minimal perfect hash index of its keys."""

from __future__ import annotations

import io
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import files, pieces
from .common import new_path, partitions, small_batches, stored
from .mphf import PerfectHash, fingerprint

END, NULL_KEY, CACHED, VERSION = 0, -(2**63), 250_000, 2
#: Bytes of text a shard is made for, at least as long as there is work for all partitions, and bytes of ids read at once.
SHARD_BYTES, PART_BYTES, READ_BYTES = 256 << 20, 8 << 20, 4 << 20
MANIFEST = "shard int, path string, first long, docs long, tokens long, base long"


class Encoder:
    """Ids of whole texts, from the tokenizers library.

    Its byte-level BPE never merges across the pieces that its pre-tokenizer cuts, so each distinct piece is encoded
    once and kept (at most CACHED pieces, told apart by 128 bits of hash); texts are strung together from these. A
    text that holds an added token is encoded whole, and so are all texts by a tokenizer with any other pre-tokenizer
    or a normalizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        pre = str(self.tok.pre_tokenizer)
        self.by_piece = self.tok.normalizer is None and pre.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in pre
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2") if self.tok.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.clear()

    def clear(self) -> None:
        self.known, self.used = pieces.Table(), 0
        self.flat, self.start, self.size = np.zeros(1 << 16, self.dtype), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)

    def learn(self, new: list[str], h: np.ndarray, check: np.ndarray) -> None:
        got = [e.ids for e in self.tok.encode_batch_fast(new, add_special_tokens=False)]
        size = np.fromiter(map(len, got), np.int32, len(got))
        n, total = self.known.size, int(size.sum())
        self.flat, self.start, self.size = (a if have + more <= len(a) else np.concatenate([a, np.zeros(max(len(a), more), a.dtype)]) for a, have, more in ((self.flat, self.used, total), (self.start, n, len(new)), (self.size, n, len(new))))
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(got), self.dtype, total)
        self.start[n : n + len(new)], self.size[n : n + len(new)] = self.used + np.cumsum(size) - size, size
        self.known.add(h, check)
        self.used += total

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with END after it, and the number of ids of each."""
        if not self.by_piece:
            return self.of_wholes(texts)
        odd = [i for i, t in enumerate(texts) if any(a in t for a in self.added)]
        if odd:
            plain = sorted(set(range(len(texts))) - set(odd))
            ids, n = self.of_pieces([texts[i] for i in plain])
            runs = np.split(ids, np.cumsum(n)[:-1]) if len(n) else []
            for i in odd:
                runs.insert(i, self.of_wholes([texts[i]])[0])
            return np.concatenate(runs), np.fromiter(map(len, runs), np.int64, len(runs))
        return self.of_pieces(texts)

    def of_wholes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [[*e.ids, END] for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(got), self.dtype), np.fromiter(map(len, got), np.int64, len(got))

    def of_pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        offs = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
        starts = pieces.cut(points, offs)
        h, check = pieces.hashes(points, starts)
        at = self.known.find(h, check)
        if (at < 0).any():
            new = np.flatnonzero(at < 0)
            new = new[np.unique(h[new], return_index=True)[1]]
            if self.known.size + len(new) > CACHED:
                self.clear()
                new = np.unique(h, return_index=True)[1]
            ends = np.append(starts[1:], len(points))
            self.learn([whole[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)], h[new], check[new])
            at = self.known.find(h, check)
        size = self.size[at]
        before = np.cumsum(size, dtype=np.int64) - size
        total = int(size.sum(dtype=np.int64))
        of = np.diff(np.searchsorted(starts, offs))  # pieces of each text
        per = np.add.reduceat(np.append(size, 0), np.minimum(np.cumsum(of) - of, len(size)), dtype=np.int64) * (of > 0)
        # Each text's END comes after its ids, so every id moves on by the number of texts before its own.
        place = np.arange(total) + np.repeat(np.arange(len(texts)), per)
        ids = np.full(total + len(texts), END, self.dtype)
        ids[place] = self.flat[np.arange(total) + np.repeat(self.start[at] - before, size)]
        return ids, per + 1


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pack_index(keys: np.ndarray, sizes: np.ndarray, width: int) -> bytes:
    """Index of a shard whose documents lie in ascending order of ``keys``; rows of one key form one run. It holds the
    perfect hash, a fingerprint, first row and run for each slot, and the offsets of rows; no keys."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    distinct = keys[first]
    ph = PerfectHash.build(distinct)
    slot = ph(distinct)
    prints, rows, runs = np.zeros(len(first), np.uint32), np.zeros(len(first), np.uint32), np.zeros(len(first), np.uint32)
    prints[slot], rows[slot], runs[slot] = fingerprint(distinct), first, np.diff(first, append=len(keys))
    out = io.BytesIO()
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("<i8")
    for part in (np.array([VERSION, width], "<i8"), ph.sizes, ph.bits, prints, rows, runs, offsets):
        np.save(out, part, allow_pickle=False)
    return out.getvalue()


class Shard:
    """A shard read back. find() is keyed access in constant time: hash, fingerprint, row; ids are read by range."""

    def __init__(self, path: str):
        data = io.BytesIO(files.read_all(f"{path}.idx"))
        (version, width), sizes, bits, self.prints, self.rows, self.runs, self.offsets = (np.load(data, allow_pickle=False) for _ in range(7))
        if version != VERSION:
            raise ValueError(f"{path}: version {version}")
        self.hash, self.dtype, self.path = PerfectHash(sizes, bits), np.dtype(f"<u{width}"), path
        self.file = files.Ranged(f"{path}.ids")
        if self.file.size != self.offsets[-1] * width:
            raise ValueError(f"{path}: {self.file.size} bytes, the index has {self.offsets[-1]} ids")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and number of rows of each key; -1 and 0 where the stored fingerprint differs."""
        slot = self.hash(keys)
        ok = slot >= 0
        ok[ok] = self.prints[slot[ok]] == fingerprint(np.asarray(keys, np.int64)[ok])
        row, run = np.full(len(slot), -1, np.int64), np.zeros(len(slot), np.int64)
        row[ok], run[ok] = self.rows[slot[ok]], self.runs[slot[ok]]
        return row, run

    def tokens(self, row: int, rows: int = 1) -> np.ndarray:
        """Ids of ``rows`` documents that lie one after the other."""
        lo, hi = int(self.offsets[row]), int(self.offsets[row + rows])
        return np.frombuffer(self.file.at(lo * self.dtype.itemsize, (hi - lo) * self.dtype.itemsize), self.dtype)

    def close(self) -> None:
        self.file.close()


def write_shards(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None, out: str | None = None) -> DataFrame:
    """Writes the ids of every text (null: empty), each with id 0 after it, in ascending ``id_col`` order.

    Returns the manifest, a row a shard: shard, path (two files: .ids raw little-endian ids, as wide as the
    vocabulary needs, and .idx), first (its least key), docs, tokens and base (ids in all shards before it). Rows of one
    id all stay, next to each other; a null id is kept as the least long. Other columns are not read. An empty table
    has no shards.

    Texts move once, to ranges of the key: ``shards`` of them, or as many as SHARD_BYTES of text each ask for (where
    these are few, up to one a shuffle partition of PART_BYTES at least). A shard streams to its file, which gets its
    name when whole, so a task that is run again writes the same file; only its keys and sizes are held in memory.
    """
    spark = docs.sparkSession
    small_batches(spark)
    out = out or new_path(spark, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = next((b for b in batches if b.num_rows), None)
        if batch is None:
            return
        shard = TaskContext.get().partitionId()
        path, enc, keys, sizes = f"{out}/shard-{shard:07d}", encoder(tokenizer), [], []
        with files.committed(f"{path}.ids") as f:
            while batch is not None:
                texts = [t or "" for t in batch.column(1).to_pylist()]
                for i in range(0, len(texts), 128):
                    ids, n = enc(texts[i : i + 128])
                    f.write(ids.tobytes())
                    sizes.append(n)
                keys.append(batch.column(0).to_numpy(zero_copy_only=False))
                batch = next((b for b in batches if b.num_rows), None)
        keys, sizes = np.concatenate(keys), np.concatenate(sizes)
        with files.committed(f"{path}.idx") as f:
            f.write(pack_index(keys, sizes, enc.dtype.itemsize))
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [path], "first": [int(keys[0])], "docs": [len(keys)], "tokens": [int(sizes.sum())]})

    base = docs.select(key_of(id_col).alias("id"), F.col(text_col).alias("text"))
    if shards is None:
        size = base.agg(F.sum(F.octet_length("text"))).head()[0] or 0
        shards = max(1, -(-size // SHARD_BYTES), min(partitions(spark), -(-size // PART_BYTES)))
    ranged = base.repartitionByRange(shards, "id").sortWithinPartitions("id", "text")
    rows = sorted(stored(ranged.mapInArrow(write, "shard int, path string, first long, docs long, tokens long"), "manifest").collect())
    done, full = 0, []
    for r in rows:  # one row a shard
        full.append((*r, done))
        done += r["tokens"]
    return spark.createDataFrame(full, MANIFEST)


def key_of(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_KEY).cast("long"))


def read_shards(manifest: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row for each document that the shards hold under a key of ``docs``: ``id_col``, start, n_tokens, ids_crc32 (of its
    ids as little-endian 32-bit integers) and shard. A key that its shard doesn't hold is an error.

    Each distinct key goes to the shard whose range it lies in, which gives its offset by the perfect hash; ids are read
    by ranges of about READ_BYTES, as many keys at once as lie one after the other. The manifest, a row a shard, is the
    only thing that tasks hold besides one shard's index.
    """
    spark = docs.sparkSession
    small_batches(spark)
    some = sorted(manifest.select("first", "shard", "path", "base").collect())
    schema = f"`{id_col}` long, start long, n_tokens long, ids_crc32 long, shard int"
    if not some:
        return spark.createDataFrame([], schema)
    firsts, shards, paths, bases = (list(v) for v in zip(*some, strict=True))
    names = [id_col, "start", "n_tokens", "ids_crc32", "shard"]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.searchsorted(np.array(firsts, np.int64), b.column(0).to_numpy(), "right") - 1
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.maximum(at, 0), pa.int32())], ["key", "at"])

    def fetch(s: Shard, at: int, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        row, run = s.find(keys)
        if (row < 0).any():
            raise KeyError(f"{s.path}: no key {keys[row < 0][0]}")
        width, i = s.dtype.itemsize, 0
        while i < len(keys):
            j = i + 1  # keys i to j - 1 lie one after the other
            while j < len(keys) and row[j] == row[j - 1] + run[j - 1] and (s.offsets[row[j] + run[j]] - s.offsets[row[i]]) * width <= READ_BYTES:
                j += 1
            rows = int(row[j - 1] + run[j - 1] - row[i])
            ends = s.offsets[row[i] : row[i] + rows + 1]
            ids = s.tokens(int(row[i]), rows).astype("<u4")
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip((ends[:-1] - ends[0]).tolist(), (ends[1:] - ends[0]).tolist(), strict=True)]
            of = np.repeat(keys[i:j], run[i:j])
            yield pa.RecordBatch.from_arrays([pa.array(of, mask=of == NULL_KEY), pa.array(bases[at] + ends[:-1], pa.int64()), pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64()), pa.array([shards[at]] * rows, pa.int32())], names)
            i = j

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, s = None, None
        for b in batches:
            keys, at = b.column(0).to_numpy(), b.column(1).to_numpy()
            for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at)) + 1):
                if len(part):
                    if at[part[0]] != now:
                        if s:
                            s.close()
                        now, s = int(at[part[0]]), Shard(paths[at[part[0]]])
                    yield from fetch(s, now, keys[part])
        if s:
            s.close()

    keys = docs.select(key_of(id_col).alias("key")).distinct().mapInArrow(route, "key long, at int")
    return keys.repartitionByRange(max(1, partitions(spark)), "key").sortWithinPartitions("key").mapInArrow(read, schema)
