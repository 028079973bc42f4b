"""Line deduplication with sharded minimal perfect hashes.

Lines are known by a 128-bit hash of their key (the line stripped of `[\\x20\\x09-\\x0D]`, A-Z lower-cased). The hashes of lines
that enough documents hold are dealt to shards by their first bits. A shard is a minimal perfect hash over its hashes, laid out as
cascaded bit arrays, and three arrays in its order: fingerprints (the other 64 bits), document counts and the largest holder's id.
Documents probe the arrays; lines are never joined with lines.

If all shards fit in `broadcast_bytes` they are broadcast and every document is read, probed and answered where it lies. Beyond
that, documents send each shard the packed hashes of their lines, shards answer with those to drop, and the answers, one packed
row a document and shard, meet the texts by id. Both ways give the same rows. Documents of any length are split whole.

A null or empty text is one empty line. Lines are counted by row of the table: a line that a document repeats counts once. A null
id is less than any other; of rows with the same id, all count, and all keep the line if that id is the largest that holds it. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, SPACE, id_and_text, materialise, text_bytes

MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _mixed(x: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64((level + 1) * MIX[0] & (1 << 64) - 1)) * np.uint64(MIX[1])
        x = (x ^ (x >> np.uint64(29))) * np.uint64(MIX[2])
        return x ^ (x >> np.uint64(32))


class PerfectHash:
    """A minimal perfect hash over distinct 64-bit numbers: level by level, a number gets the bit it falls on if it is alone
    there, else it goes on to the next level; its place is the count of bits before its own."""

    def __init__(self, levels: list[np.ndarray], ranks: list[np.ndarray], starts: list[int]) -> None:
        self.levels, self.ranks, self.starts = levels, ranks, starts

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        levels, ranks, starts, placed = [], [], [], 0
        if len(np.unique(keys)) < len(keys):
            raise ValueError("numbers that are the same never part")
        while len(keys):
            size = max(64, int(len(keys) * gamma) + 63 & ~63)
            at = _mixed(keys, len(levels)) % np.uint64(size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            bits = np.packbits(alone, bitorder="little").view(np.uint64)
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)))
            levels.append(bits)
            ranks.append(before[:-1].astype(np.uint32))
            starts.append(placed)
            placed += int(before[-1])
            keys = keys[~alone[at.astype(np.int64)]]
        return cls(levels, ranks, starts)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """For a number of the set, its place; for another, any place or -1."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for k, (bits, rank, start) in enumerate(zip(self.levels, self.ranks, self.starts, strict=True)):
            if not len(todo):
                break
            at = _mixed(keys[todo], k) % np.uint64(len(bits) * 64)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            here = (bits[word] >> bit & np.uint64(1)).astype(bool)
            hit = here.nonzero()[0]
            below = bits[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[todo[hit]] = start + rank[word[hit]] + np.bitwise_count(below)
            todo = todo[~here]
        return out


class Shard:
    """Arrays in the order of a minimal perfect hash over the lines' first 64 bits. Of the lines that share these, all but one are kept
    aside, in `others`: at a billion lines there are a few."""

    def __init__(self, keys: np.ndarray, prints: np.ndarray, counts: np.ndarray, holders: np.ndarray) -> None:
        own = np.zeros(len(keys), bool)
        own[np.unique(keys, return_index=True)[1]] = True
        rest = [x[~own].tolist() for x in (keys, prints, counts, holders)]
        self.others = {(k, p): (n, h) for k, p, n, h in zip(*rest, strict=True)}
        keys, prints, counts, holders = keys[own], prints[own], counts[own], holders[own]
        self.hash = PerfectHash.build(keys)
        place = self.hash.places(keys)
        self.prints, self.counts, self.holders = np.empty_like(prints), np.empty(len(keys), np.uint32), np.empty_like(holders)
        self.prints[place], self.counts[place], self.holders[place] = prints, np.minimum(counts, 2**32 - 1), holders

    def drops(self, keys: np.ndarray, prints: np.ndarray, ids: np.ndarray, min_docs: int) -> np.ndarray:
        """Which of these lines, held by these documents, go: those that enough documents hold, the largest of them another."""
        place = self.hash.places(keys)
        known = place >= 0
        known[known] = self.prints[place[known]] == prints[known]
        known[known] = (self.counts[place[known]] >= min_docs) & (self.holders[place[known]] != ids[known])
        if self.others:
            for i, line in enumerate(zip(keys.tolist(), prints.tolist(), strict=True)):
                if line in self.others:
                    n, holder = self.others[line]
                    known[i] = n >= min_docs and holder != ids[i]
        return known


def line_key(line: bytes, least: int) -> bytes | None:
    """The key, or none if it is too short to count."""
    key = line.strip(SPACE).lower()
    if len(key) < least or (not key.isascii() and len(key.decode("utf-8", "replace")) < least):
        return None
    return key


def line_hashes(lines: list[bytes], least: int) -> np.ndarray:
    """A row of two numbers for each line; zeros where it doesn't count."""
    empty = bytes(16)
    keys = (line_key(x, least) for x in lines)
    return np.frombuffer(b"".join(empty if k is None else hashlib.blake2b(k, digest_size=16).digest() for k in keys), np.uint64).reshape(-1, 2)


def _ids(column) -> np.ndarray:
    return np.array([NULL_ID if x is None else x for x in column.to_pylist()], np.int64)


def line_counts(docs: DataFrame, *, least: int, min_docs: int) -> DataFrame:
    """(hi, lo, n, holder): the hashes that at least `min_docs` rows hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, ids = [np.zeros((0, 2), np.uint64)], [np.zeros(0, np.int64)]
            for i, text in zip(_ids(batch.column(0)).tolist(), text_bytes(batch.column(1)), strict=True):
                found = line_hashes(text.split(b"\n"), least)
                found = np.unique(found[found.any(1)], axis=0) if len(found) > 1 else found[found.any(1)]
                parts.append(found)
                ids.append(np.full(len(found), i, np.int64))
            rows, ids = np.concatenate(parts).view(np.int64), np.concatenate(ids)
            # What one batch holds several times is summed before it leaves the task.
            rows, where, n = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
            top = np.full(len(rows), NULL_ID, np.int64)
            np.maximum.at(top, where.ravel(), ids)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rows[:, 0].copy(), rows[:, 1].copy(), n.astype(np.int64), top)], ["hi", "lo", "n", "holder"])

    rows = id_and_text(docs).mapInArrow(run, "hi long, lo long, n long, holder long")
    return rows.groupBy("hi", "lo").agg(F.sum("n").alias("n"), F.max("holder").alias("holder")).where(F.col("n") >= min_docs)


def build_shards(counts: DataFrame, shards: int) -> DataFrame:
    """(shard, blob): pickled shards, one a row."""
    import pickle

    def build(key, group):
        cols = [group[c].to_numpy() for c in ("hi", "lo", "n", "holder")]
        shard = Shard(cols[0].view(np.uint64), cols[1].view(np.uint64), cols[2], cols[3])
        import pandas as pd

        return pd.DataFrame({"shard": [int(key[0])], "blob": [pickle.dumps(shard, 5)]})

    return counts.withColumn("shard", F.pmod("hi", F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(build, "shard int, blob binary")


REPORT = "doc_id long, n_lines long, n_dropped long, kept_text string, kept_sha256 string"


def _answer(batch: pa.RecordBatch, drops, least: int, with_text: bool) -> pa.RecordBatch:
    """drops(k, hashes): for the hashes of row k's lines, which go."""
    out = []
    for k, (i, text) in enumerate(zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True)):
        lines = text.split(b"\n")
        hashes = line_hashes(lines, least)
        gone = hashes.any(1)
        if gone.any():
            gone[gone] = drops(k, hashes[gone])
        kept = b"\n".join(x for x, g in zip(lines, gone.tolist(), strict=True) if not g) if gone.any() else text
        out.append((i, len(lines), int(gone.sum()), kept.decode("utf-8", "replace") if with_text else None, hashlib.sha256(kept).hexdigest()))
    columns = list(zip(*out, strict=True)) or [()] * 5
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in REPORT.split(", ")])


def dedup_lines(docs: DataFrame, *, least: int = 20, min_docs: int = 3, shard_lines: int = 1 << 20, broadcast_bytes: int = 64 << 20, with_text: bool = True) -> DataFrame:
    """doc_id, n_lines (before), n_dropped, kept_text (null unless `with_text`), kept_sha256: a row for each row of `docs`."""
    spark = docs.sparkSession
    docs = id_and_text(docs)
    min_docs = max(1, min_docs)
    counts = materialise(line_counts(docs, least=least, min_docs=min_docs))
    n = counts.count()
    shards = max(1, -(-n // shard_lines))
    built = materialise(build_shards(counts, shards))
    size = built.agg(F.sum(F.octet_length("blob"))).first()[0] or 0
    if size <= broadcast_bytes:
        return _probe_here(docs, spark.sparkContext.broadcast({r.shard: bytes(r.blob) for r in built.toLocalIterator()}), shards, least, min_docs, with_text)
    return _probe_there(docs, built, shards, least, min_docs, with_text)


def _probe_here(docs: DataFrame, blobs, shards: int, least: int, min_docs: int, with_text: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        tables = {k: pickle.loads(v) for k, v in blobs.value.items()}
        for batch in batches:
            ids = _ids(batch.column(0))

            def drops(k: int, hashes: np.ndarray, ids=ids) -> np.ndarray:
                hi, lo = hashes[:, 0].copy(), hashes[:, 1].copy()
                home = np.mod(hi.view(np.int64), shards)
                out = np.zeros(len(hi), bool)
                for s in set(home.tolist()) & tables.keys():
                    own = home == s
                    out[own] = tables[s].drops(hi[own], lo[own], np.full(int(own.sum()), ids[k]), min_docs)
                return out

            yield _answer(batch, drops, least, with_text)

    return docs.mapInArrow(run, REPORT)


def _probe_there(docs: DataFrame, built: DataFrame, shards: int, least: int, min_docs: int, with_text: bool) -> DataFrame:
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each batch and shard one row: hashes and ids, packed; also a part number that spreads a shard's askers."""
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for batch in batches:
            hashes, ids = [np.zeros((0, 2), np.uint64)], [np.zeros(0, np.int64)]
            for i, text in zip(_ids(batch.column(0)).tolist(), text_bytes(batch.column(1)), strict=True):
                found = line_hashes(text.split(b"\n"), least)
                hashes.append(found := found[found.any(1)])
                ids.append(np.full(len(found), i, np.int64))
            h, ids = np.concatenate(hashes), np.concatenate(ids)
            home = np.mod(h[:, 0].copy().view(np.int64), shards)
            rows = [(int(s), task % SPREAD, np.column_stack([h[own := home == s], ids[own].view(np.uint64)]).tobytes()) for s in np.unique(home)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["shard", "part", "asked"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by shard and part, the blob first: it is loaded once and probed by what follows."""
        import pickle

        table, now = None, None
        for batch in batches:
            for shard, blob, asked in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if blob is not None:
                    table, now = pickle.loads(blob), shard
                    continue
                if shard != now:  # no line of this shard is dropped
                    continue
                rows = np.frombuffer(asked, np.uint64).reshape(-1, 3)
                hi, lo, ids = rows[:, 0].copy(), rows[:, 1].copy(), rows[:, 2].copy().view(np.int64)
                gone = table.drops(hi, lo, ids, min_docs)
                yield pa.RecordBatch.from_arrays([pa.array(ids[gone]), pa.array(hi[gone].view(np.int64)), pa.array(lo[gone].view(np.int64))], ["i", "hi", "lo"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [{tuple(p.values()) for p in x or ()} for x in batch.column(2).to_pylist()]
            yield _answer(batch, lambda k, h, s=sets: np.array([tuple(r) in s[k] for r in h.view(np.int64).tolist()], bool), least, with_text)

    blob = F.lit(None).cast("binary")
    asked = docs.mapInArrow(ask, "shard int, part int, asked binary").select("shard", "part", blob.alias("blob"), "asked")
    held = built.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))).select("shard", "part", "blob", blob.alias("asked"))
    met = asked.unionByName(held).repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("blob").isNull())
    gone = met.select("shard", "blob", "asked").mapInArrow(answer, "i long, hi long, lo long").distinct()
    sets = gone.groupBy("i").agg(F.collect_list(F.struct("hi", "lo")).alias("gone"))
    joined = docs.join(sets, F.coalesce("doc_id", F.lit(NULL_ID)) == F.col("i"), "left").select("doc_id", "text", "gone")
    return joined.mapInArrow(finish, REPORT)


#: Parts into which a shard's askers are spread, each with its own copy of the shard.
SPREAD = 4
