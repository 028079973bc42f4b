"""Token output in training order.

Documents are encoded once; their tokens, each document closed by an end token, make one stream, cut into sequences of a fixed length.
The stream has the order of ids, and of a hash of the text under one id, however the table is split into files and tasks: where a
document lies in it follows from running sums over a table of ids and lengths only. Sequence i of N gets slot p(i), p a keyed Feistel
permutation of range(N) (walked along its cycle into the range), so the training order is a shuffle that nobody has to store: any
slot's sequence, and any sequence's slot, can be computed. Pieces move once, dealt by ranges of slots; a shard is a run of slots,
sorted, each of the same number of bytes, so slot s is read at (s mod slots-a-shard) * stride of its shard, and a reader resumes at
any slot. Each range is a number of whole shards, about `task_bytes`, so tasks grow in number with the data, not in size. The shards
can be written in rounds, each of a run of them: a round cuts its own pieces out of the encoded table, and what it shuffled goes before
the next, so that the shuffle of one round is on the disks at once and not that of all tokens.

The last sequence is filled up with end tokens. A null or empty text is an end token only; a null id comes last and is kept as null;
repeated rows are encoded each. A text of any length is encoded whole and cut. An empty table gives no sequences and no shards.
"""

from __future__ import annotations

import atexit
import base64
import struct
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import delete, shared_dir
from .common import id_and_text, materialise
from .feistel import permute_array

# Fixed value: how byte-level BPE vocabularies of this family split text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


def encoder(ranks: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(task, at, n, doc_id, tie, tokens): at numbers the rows of a task, tie is a hash of the text; tokens are unsigned shorts. The
    vocabulary, some 50,000 ranks, is read on the driver and broadcast."""
    ranks = load_ranks(vocabulary)
    if len(ranks) >= 2**16 - 1:
        raise ValueError("two bytes a token hold 65,534 ids and the end token")
    shared, end = docs.sparkSession.sparkContext.broadcast(ranks), len(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, at, bpe = TaskContext.get().partitionId(), 0, encoder(shared.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                rows = [np.array([*bpe.encode_ordinary(t), end], "<u2") for t in texts]
                tie = np.array([xxhash.xxh64_intdigest(t.encode()) for t in texts], np.uint64).view(np.int64)
                n = np.array([len(r) for r in rows], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), task)), pa.array(np.arange(at, at + len(rows))), pa.array(n), part.column(0), pa.array(tie), pa.array([r.tobytes() for r in rows], pa.binary())],
                    ["task", "at", "n", "doc_id", "tie", "tokens"],
                )
                at += len(rows)

    return id_and_text(docs).mapInArrow(run, "task long, at long, n long, doc_id long, tie long, tokens binary")


def stream_starts(table: DataFrame, rows: int, part_rows: int = 1 << 20) -> DataFrame:
    """(task, at, start): how many tokens the stream has before each row of `encoded`. Running sums within ranges of ids, and of the
    ranges' sums."""
    order = F.col("doc_id").isNull(), F.col("doc_id"), F.col("tie")
    parts = max(1, -(-rows // part_rows))
    dealt = materialise(table.select("task", "at", "n", "doc_id", "tie").repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("part").agg(F.sum("n").alias("sum")).select("part", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    running = dealt.withColumn("own", F.sum("n").over(own) - F.col("n"))
    return running.join(F.broadcast(sums), "part").select("task", "at", (F.col("base") + F.col("own")).alias("start"))


def starts_found(table: DataFrame, broadcast_rows: int) -> tuple[Callable[[int, int, int], np.ndarray], int]:
    """How tasks find the starts of rows at..upto of a task of `encoded`, and the number of tokens in all. Up to `broadcast_rows` starts
    are broadcast, packed by task; more of them are files of eight bytes a row in the shared folder, so that the tokens need not meet
    them by a join."""
    spark = table.sparkSession
    rows, total = table.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    starts = stream_starts(table, rows)
    if rows > broadcast_rows:
        folder = f"{shared_dir(spark)}/starts-{uuid.uuid4().hex}"
        atexit.register(delete, spark, folder)
        write_starts(starts, folder, rows)

        def read(task: int, at: int, upto: int) -> np.ndarray:
            files, top = _files(folder)
            with files.open_input_file(str(PurePosixPath(top) / f"{task}.bin")) as file:
                file.seek(8 * at)
                return np.frombuffer(file.read(8 * (upto - at)), "<i8")

        return read, total
    packed = materialise(starts).groupBy("task").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "start"))), lambda x: x["start"]).alias("starts"))
    shared = spark.sparkContext.broadcast({r.task: np.array(r.starts, np.int64) for r in packed.toLocalIterator()})
    return lambda task, at, upto: shared.value[task][at:upto], total


def write_starts(starts: DataFrame, folder: str, rows: int, part_rows: int = 1 << 20) -> None:
    """A file for each task, its rows' starts in their order; whole or not at all, as `write_shards` does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, top = _files(folder)
        files.create_dir(top, recursive=True)
        mark, now, out = TaskContext.get().taskAttemptId(), None, None
        temp = lambda: str(PurePosixPath(top) / f".{now}.{mark}")

        def close() -> None:
            out.close()
            files.move(temp(), str(PurePosixPath(top) / f"{now}.bin"))

        for batch in batches:
            task, start = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype("<i8")
            cuts = [0, *(np.flatnonzero(np.diff(task)) + 1).tolist(), len(task)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if int(task[i]) != now:
                    if out is not None:
                        close()
                    now = int(task[i])
                    out = files.open_output_stream(temp())
                out.write(start[i:j].tobytes())
        if out is not None:
            close()
        yield from ()

    parts = max(int(starts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // part_rows))
    starts.repartition(parts, "task").sortWithinPartitions("task", "at").select("task", "start").mapInArrow(run, "task long").count()


def piece_dictionary(table: DataFrame, length: int, rows: int = 400, pieces: int = 8) -> zstandard.ZstdCompressionDict | None:
    """A dictionary for compressing pieces on their way, trained on the first pieces of a few rows; none if these are too few. What is
    compressed comes back as it was, whatever the dictionary."""
    found = [r.tokens for r in table.select(F.substring("tokens", 1, 2 * length * pieces).alias("tokens")).limit(rows).collect()]
    samples = [bytes(x[i : i + 2 * length]) for x in found for i in range(0, len(x), 2 * length)]
    try:
        return zstandard.train_dictionary(1 << 16, samples)
    except (zstandard.ZstdError, ValueError):
        return None


def training_order(docs: DataFrame, **options) -> DataFrame:
    """A row for each sequence, sorted within its shard: slot, shard, byte_offset (in the shard), sequence, n_tokens (without the
    filling), doc_ids (of the documents it has tokens of, in order), tokens (binary, 2 * length bytes). Options as `training_rounds`."""
    return training_rounds(docs, rounds=1, **options)[0]


def training_rounds(
    docs: DataFrame,
    *,
    rounds: int = 2,
    length: int = 1024,
    slots: int = 4096,
    key: int = 20260101,
    vocabulary: str = VOCABULARY,
    task_bytes: int = 128 << 20,
    broadcast_rows: int = 1 << 21,
) -> list[DataFrame]:
    """The rows of `training_order` in as many tables (fewer, if there are fewer shards), each of a run of whole shards, in their order.
    Documents are encoded once for all of them; each reads all tokens and moves its own."""
    spark = docs.sparkSession
    table = materialise(encoded(docs, vocabulary), level=9)
    starts_of, total = starts_found(table, broadcast_rows)
    count = -(-total // length)
    end, words = len(load_ranks(vocabulary)), piece_dictionary(table, length)
    shared = spark.sparkContext.broadcast(words.as_bytes() if words is not None else None)
    known = lambda: None if shared.value is None else zstandard.ZstdCompressionDict(shared.value)

    def cut(low: int, high: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Pieces of the slots low..high, compressed each, as shuffles of tokens are large."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = zstandard.ZstdCompressor(level=3, dict_data=known(), write_dict_id=False)
            for batch in batches:
                task, at, n = (batch.column(k).to_numpy() for k in range(3))
                start = np.empty(len(n), np.int64)
                cuts = [0, *(np.flatnonzero((np.diff(task) != 0) | (np.diff(at) != 1)) + 1).tolist(), len(n)]
                for i, j in zip(cuts, cuts[1:]):
                    if i < j:
                        start[i:j] = starts_of(int(task[i]), int(at[i]), int(at[j - 1]) + 1)
                first, last = start // length, (start + n - 1) // length
                row = np.repeat(np.arange(len(n)), last - first + 1)
                sequence = np.arange(len(row)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1) + first[row]
                slot = permute_array(sequence, count, key)
                own = np.flatnonzero((slot >= low) & (slot < high))
                row, sequence, slot = row[own], sequence[own], slot[own]
                begin, stop = np.maximum(start[row], sequence * length), np.minimum(start[row] + n[row], (sequence + 1) * length)
                tokens, pieces, now, data = batch.column(4), [], -1, b""
                for r, i, j in zip(row.tolist(), (2 * (begin - start[row])).tolist(), (2 * (stop - start[row])).tolist(), strict=True):
                    if r != now:
                        now, data = r, memoryview(tokens[r].as_buffer())
                    pieces.append(codec.compress(data[i:j]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slot), pa.array(sequence), pa.array((begin - sequence * length).astype(np.int32)), batch.column(3).take(pa.array(row)), pa.array(pieces, pa.binary())],
                    ["slot", "sequence", "at", "doc_id", "tokens"],
                )

        return run

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces come sorted by slot and place."""
        now, ids, parts, codec = None, [], [], zstandard.ZstdDecompressor(dict_data=known())

        def closed() -> tuple:
            data = b"".join(parts)
            n = len(data) // 2
            return (now[0], now[0] // slots, now[0] % slots * 2 * length, now[1], n, list(ids), data + struct.pack("<H", end) * (length - n))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in SEQUENCES.split(", ")])

        for batch in batches:
            out = []
            for slot, sequence, doc_id, tokens in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if now is not None and now[0] != slot:
                    out.append(closed())
                    ids.clear()
                    parts.clear()
                now = (slot, sequence)
                ids.append(doc_id)
                parts.append(codec.decompress(tokens))
            if out:
                yield batch_of(out)
        if parts:
            yield batch_of([closed()])

    shards = max(1, -(-count // slots))
    rounds = min(rounds, shards)
    bounds = [shards * k // rounds for k in range(rounds + 1)]

    def dealt(low: int, high: int) -> DataFrame:
        """The sequences of shards low..high. A range of whole shards a task, equal ranges, as slots are all taken."""
        tasks = min(high - low, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * length * min(count, slots * (high - low)) // task_bytes)))
        pieces = table.select("task", "at", "n", "doc_id", "tokens").mapInArrow(cut(low * slots, high * slots), "slot long, sequence long, at int, doc_id long, tokens binary")
        ranged = pieces.repartitionById(tasks, ((F.floor(F.col("slot") / slots) - low) * tasks / (high - low)).cast("int")).sortWithinPartitions("slot", "at")
        return ranged.select("slot", "sequence", "doc_id", "tokens").mapInArrow(join, SEQUENCES)

    return [dealt(low, high) for low, high in zip(bounds, bounds[1:])]


SEQUENCES = "slot long, shard long, byte_offset long, sequence long, n_tokens int, doc_ids array<long>, tokens binary"


def _files(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


WRITTEN = "slot long, shard long, path string, byte_offset long, sequence long, n_tokens int, doc_ids array<long>"


#: Spark removes what a write has shuffled when the write is done, not when the driver's memory is next cleared.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_shards(sequences: DataFrame, folder: str) -> DataFrame:
    """Writes shard-NNNNNN.bin files to a folder that all executors reach, whole or not at all (under another name, then renamed, so a
    retried task replaces what it wrote), and returns their index: a row for each sequence, as `training_order` has it, with the path
    in place of the tokens. What was shuffled for them is removed then, as nothing reads it again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, top = _files(folder)
        files.create_dir(top, recursive=True)
        mark, now, out, temp = TaskContext.get().taskAttemptId(), None, None, ""
        path = lambda shard: str(PurePosixPath(top) / f"shard-{shard:06d}.bin")

        def close() -> None:
            out.close()
            files.move(temp, path(now))

        for batch in batches:
            slot, shard, offset, sequence, n, ids, tokens = (batch.column(k) for k in range(7))
            shards = shard.to_pylist()
            for own, data in zip(shards, tokens.to_pylist(), strict=True):
                if own != now:
                    if out is not None:
                        close()
                    now, temp = own, str(PurePosixPath(top) / f".shard-{own:06d}.{mark}")
                    out = files.open_output_stream(temp)
                out.write(data)
            yield pa.RecordBatch.from_arrays([slot, shard, pa.array([path(x) for x in shards], pa.string()), offset, sequence, n, ids], [x.split()[0] for x in WRITTEN.split(", ")])
        if out is not None:
            close()

    spark = sequences.sparkSession
    kept = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        return materialise(sequences.mapInArrow(run, WRITTEN))
    finally:
        spark.conf.set(CLEANUP, kept)


def write_rounds(rounds: list[DataFrame], folder: str) -> DataFrame:
    """`write_shards` of one table after the other, and the index of all."""
    return reduce(DataFrame.unionAll, [write_shards(sequences, folder) for sequences in rounds])


def read_shards(index: DataFrame, folder: str, *, length: int = 1024) -> DataFrame:
    """The index with `tokens`, as they are read from the shards, file after file in the order of slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, now, file = _files(folder)[0], None, None
        for batch in batches:
            tokens = []
            for path, offset in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if path != now:
                    if file is not None:
                        file.close()
                    now, file = path, files.open_input_file(path)
                if file.tell() != offset:
                    file.seek(offset)
                tokens.append(file.read(2 * length))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tokens, pa.binary())], [*batch.schema.names, "tokens"])

    return index.mapInArrow(run, WRITTEN + ", tokens binary")


def read_slots(folder: str, start: int, *, length: int = 1024, slots: int = 4096) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, tokens) from a slot on, sequentially over the shards."""
    from pyarrow import fs

    files, top = _files(folder)
    stride, shard = 2 * length, start // slots
    while files.get_file_info(path := str(PurePosixPath(top) / f"shard-{shard:06d}.bin")).type != fs.FileType.NotFound:
        with files.open_input_file(path) as file:
            at = max(0, start - shard * slots)
            file.seek(at * stride)
            while data := file.read(stride):
                yield shard * slots + at, np.frombuffer(data, "<u2")
                at += 1
        shard += 1
