"""Exact deduplication by composable polynomial fingerprints.

A text is reduced to the bytes that stay after deleting `[\\x20\\x09-\\x0D]`. Its fingerprint is the value of the polynomial
with those bytes as coefficients, modulo two primes, beside its length. Fingerprints compose: H(ab) = H(a) r^|b| + H(b), so
chunks are hashed on their own and combined by length-shifted arithmetic; slices of huge documents are hashed by different tasks.

Equal fingerprints are only candidates. The texts of candidates are then compared chunk by chunk: chunks are dealt by fingerprint
and place, so the chunks of a huge text are compared by different tasks, and no text travels in one piece. Each task first folds
the copies that it meets itself into one, so a text with a billion copies crosses the network once for each task. Where a comparison
finds two texts under one fingerprint, the rows of that fingerprint are grouped by SHA-256 too.

Nulls count as empty texts; empty texts are equal to each other; a null id sorts after all others. Of rows that are the same, or tie
in length and id, exactly one stays: rows are told apart by their place in the table, not by their id. An empty table gives an empty
result. A text of any length is hashed whole, slice by slice above `huge` bytes.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, code_points, materialise, text_bytes, tidy, told_apart, without

PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1664525123)
CHUNK = 4096
KEY = ("n_bytes", "f1", "f2")


@lru_cache(8)
def _powers(primes: tuple[int, int]) -> tuple[np.ndarray, list[int]]:
    """base^(CHUNK-1) .. base^0 for both primes, as doubles: 4096 products below 2^39 sum exactly below 2^53."""
    table = np.empty((CHUNK, len(primes)))
    for k, (p, r) in enumerate(zip(primes, BASES, strict=True)):
        x = 1
        for i in range(CHUNK - 1, -1, -1):
            table[i, k] = x
            x = x * r % p
    return table, [pow(r, CHUNK, p) for p, r in zip(primes, BASES, strict=True)]


def polynomial(data: bytes, primes: tuple[int, int] = PRIMES) -> tuple[int, int, int]:
    """(length, hash, hash). Each chunk is one row of a matrix product; chunk hashes then combine by Horner's rule."""
    n = len(data)
    table, shift = _powers(primes)
    pad = -n % CHUNK
    rows = np.frombuffer(bytes(pad) + data, np.uint8).reshape(-1, CHUNK)
    out = []
    sums = np.concatenate([rows[i : i + 256].astype(np.float64) @ table for i in range(0, len(rows), 256)]) if n else np.zeros((0, 2))
    for k, p in enumerate(primes):
        h = 0
        for x in sums[:, k].tolist():
            h = (h * shift[k] + int(x)) % p
        out.append(h)
    return n, out[0], out[1]


def combine(a: tuple[int, int, int], b: tuple[int, int, int], primes: tuple[int, int] = PRIMES) -> tuple[int, int, int]:
    """The fingerprint of the concatenation."""
    return (a[0] + b[0], *((x * pow(r, b[0], p) + y) % p for x, y, r, p in zip(a[1:], b[1:], BASES, primes, strict=True)))


def bare(data: bytes) -> bytes:
    return data.translate(None, SPACE)


FINGERPRINTS = "doc_id long, row_file long, row_line long, n_cp long, text_sha256 string, n_bytes long, f1 long, f2 long"
SLICES = "doc_id long, row_file long, row_line long, n_cp long, text_sha256 string, row string, slice long, data binary"
HASHED = "doc_id long, row_file long, row_line long, n_cp long, text_sha256 string, row string, slice long, n_bytes long, f1 long, f2 long"


def fingerprints(docs: DataFrame, *, huge: int = 16 << 20, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """doc_id, row_file, row_line (as `docs` has them, see `numbered`), n_cp (of the original), text_sha256 (of the bare text), n_bytes,
    f1, f2 for every row.

    Documents of more than `huge` bytes are cut into slices of a quarter of that, hashed by whichever task gets them, and put
    together again from three numbers a slice."""

    def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
        ids = (batch.column(k).to_pylist() for k in (0, 1, 2))
        for *row, raw in zip(*ids, text_bytes(batch.column(3)), strict=True):
            data = bare(raw)
            yield (*row, code_points(raw), hashlib.sha256(data).hexdigest()), data

    @tidy
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([(*row, *polynomial(data, primes)) for row, data in rows_of(batch)], FINGERPRINTS)

    @tidy
    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, task = 0, TaskContext.get().partitionId()
        for batch in batches:
            for row, data in rows_of(batch):
                at, step = at + 1, max(1, huge // 4)
                for k in range(0, max(len(data), 1), step):
                    yield _batch([(*row, f"{task}:{at}", k // step, data[k : k + step])], SLICES)

    @tidy
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            yield _batch([(*r[:-1], *polynomial(r[-1], primes)) for r in rows], HASHED)

    def folded(key, group):
        total = (0, 0, 0)
        for row in group.sort_values("slice")[["n_bytes", "f1", "f2"]].itertuples(index=False):
            total = combine(total, tuple(map(int, row)), primes)
        return group[["doc_id", "row_file", "row_line", "n_cp", "text_sha256"]].head(1).assign(n_bytes=total[0], f1=total[1], f2=total[2])

    length = F.octet_length("text")
    small = docs.where(length.isNull() | (length <= huge)).mapInArrow(whole, FINGERPRINTS)
    large = docs.where(length > huge).mapInArrow(slices, SLICES).repartition("row", "slice").mapInArrow(hashed, HASHED)
    return small.unionByName(large.groupBy("row").applyInPandas(folded, FINGERPRINTS))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _bit(n_bytes, f1, f2, bits: int):
    """Where a fingerprint falls in the filter; the hashes are uniform already. Works on columns and on numbers."""
    return (f1 + f2 * 31 + n_bytes * 17) % (1 << bits)


COMPARED = "n_bytes long, f1 long, f2 long, chunk long, ok boolean, data binary"
#: The largest filter of candidates that is broadcast: 2^30 bits, 128 MB, enough for 2^26 of them.
MOST_BITS = 30


def _filter_of(groups: DataFrame, bits: int) -> bytes:
    """A bitmap of 2^bits bits, those of the groups' fingerprints set."""
    place = _bit(F.col("n_bytes"), F.col("f1"), F.col("f2"), bits) + 1  # Spark's bitmaps count from 1
    maps = groups.select(F.bitmap_bucket_number(place).alias("b"), F.bitmap_bit_position(place).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("m"))
    size = 1 << (bits - 3)
    whole = np.zeros(size + 4096, np.uint8)
    for row in maps.toLocalIterator():  # at most 2^bits bits
        start = (row.b - 1) * 4096
        whole[start : start + 4096] |= np.frombuffer(bytes(row.m), np.uint8)[: len(whole) - start]
    return whole[:size].tobytes()


def collided(docs: DataFrame, groups: DataFrame, *, most_bits: int = MOST_BITS, held: int = 32 << 20, primes: tuple[int, int] = PRIMES, chunk: int = 1 << 16) -> DataFrame:
    """The fingerprints under which there are different texts: a comparison of the texts of all candidates. groups: the fingerprints
    that several rows have.

    Which rows are candidates is asked of a bitmap with 16 to 32 bits for each group, so a text that is none is sent one time in
    sixteen at most. Would that be over 2^most_bits bits, the chunks meet the groups by a join instead. A task holds one text for each
    fingerprint it has met, `held` bytes in all; what it must let go, it sends, in chunks."""
    spark, n = docs.sparkSession, groups.count()
    bits = max(16, int(16 * n - 1).bit_length()) if n else 16
    filter_ = spark.sparkContext.broadcast(_filter_of(groups, bits)) if bits <= most_bits else None

    def same(a: bytes, b: bytes) -> bool:
        return len(a) == len(b) and all(a[i : i + chunk] == b[i : i + chunk] for i in range(0, len(a), chunk))

    def sent(key: tuple, data: bytes, ok: bool) -> Iterator[tuple]:
        return ((*key, i // chunk, ok, data[i : i + chunk]) for i in range(0, len(data), chunk))

    def batched(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for row in rows:
            out.append(row)
            size += len(row[-1])
            if size > 1 << 22:
                yield _batch(out, COMPARED)
                out, size = [], 0
        if out:
            yield _batch(out, COMPARED)

    @tidy
    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = filter_.value if filter_ is not None else None
        seen: OrderedDict = OrderedDict()

        def rows() -> Iterator[tuple]:
            total = 0
            for batch in batches:
                for raw in text_bytes(batch.column(0)):
                    data = bare(raw)
                    key = polynomial(data, primes)
                    if bitmap is not None:
                        at = _bit(*key, bits)
                        if not bitmap[at >> 3] >> (at & 7) & 1:
                            continue
                    if key in seen:
                        seen.move_to_end(key)
                        if not same(seen[key], data):
                            yield from sent(key, data, False)
                        continue
                    seen[key] = data
                    total += len(data) + 200
                    while total > held and len(seen) > 1:
                        old, kept = seen.popitem(last=False)
                        total -= len(kept) + 200
                        yield from sent(old, kept, True)
            while seen:
                yield from sent(*seen.popitem(), True)

        yield from batched(rows())

    @tidy
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks come sorted by fingerprint and place."""
        key, first, ok = None, b"", True
        for batch in batches:
            out = []
            for *now, good, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != key:
                    if key is not None and not ok:
                        out.append(tuple(key[:3]))
                    key, first, ok = now, data, True
                ok = ok and good and first == data
            yield _batch(out, "n_bytes long, f1 long, f2 long")
        if key is not None and not ok:
            yield _batch([tuple(key[:3])], "n_bytes long, f1 long, f2 long")

    chunks = docs.select("text").mapInArrow(candidates, COMPARED)
    if filter_ is None:
        chunks = chunks.join(groups.select(*KEY), list(KEY), "left_semi")
    dealt = chunks.repartition(*KEY, "chunk").sortWithinPartitions(*KEY, "chunk")
    return dealt.mapInArrow(compared, "n_bytes long, f1 long, f2 long").distinct()


def _ranked(docs: DataFrame, *, huge: int = 16 << 20, primes: tuple[int, int] = PRIMES, **options) -> DataFrame:
    """A row for each row of `docs` (doc_id, row_file, row_line, text): its fingerprint, and for a text that several have, group_size and
    `best` of them."""
    prints = materialise(fingerprints(docs, huge=huge, primes=primes))
    candidates = prints.groupBy(*KEY).count().where("count > 1")
    candidates = materialise(candidates)
    twofold = collided(docs, candidates, primes=primes, **options).withColumn("twofold", F.lit(True))
    twofold = materialise(twofold)
    if twofold.isEmpty():
        keyed, key = prints, list(KEY)
    else:
        keyed = prints.join(twofold, list(KEY), "left").withColumn("exact", F.when(F.col("twofold"), F.col("text_sha256")).otherwise(""))
        key = [*KEY, "exact"]
    rank = F.struct((-F.col("n_cp")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"), "row_file", "row_line")
    best = keyed.groupBy(*key).agg(F.count("*").alias("group_size"), F.min(rank).alias("best"))
    # Written, so that the join's two sides are plain exchanges: Spark then splits the partition of a hot text, or broadcasts.
    best = materialise(best.where("group_size > 1"))
    return keyed.join(best, key, "left").withColumn("stays", F.col("best").isNull() | ((F.col("row_file") == F.col("best.row_file")) & (F.col("row_line") == F.col("best.row_line"))))


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of `docs`.

    Of equal texts the row with the most code points stays, then the smallest id (nulls last), then the first; one row is kept."""
    joined = _ranked(told_apart(docs, id_col, text_col)[0], **options)
    keep = F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.c"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("stays").alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs`, all columns, that stay: one of each group of equal texts."""
    slim, docs, file, line = told_apart(docs, id_col, text_col)
    return without(docs, _ranked(slim, **options).where(~F.col("stays")), file, line)
