"""SentencePiece encoding and decoding, giant documents by a max-plus parallel scan.

Texts up to `chunk` characters are encoded by the library, many to a task. A longer one is cut into chunks anywhere, and the chunks
go to different tasks. The state at a cut is the piece that covers or ends at it. A chunk yields a transfer matrix in the max-plus
semiring: for the states at its two cuts, the best score of a sequence of pieces from one to the other. Matrices combine
associatively; the scan of a document's matrices, a few kilobytes each, fixes the states at its cuts, and every chunk is then traced
back on its own between its two states.

The scores are those of the model's own rule, so that the scan gives the library's result. A byte-pair model doesn't maximise a sum
of piece scores, but its result is the one sequence of pieces in which every two neighbours, encoded alone, come out as those two
pieces. So two neighbours score 0 if they do and minus infinity if they don't, and the best path is the library's encoding. For a
unigram model neighbours score 0 always and a piece its log probability, the classic Viterbi lattice.

Where no piece holds a space after its first character, as in most models, a word's start is a sure cut: the matrix of a chunk with
two of them is an outer product of what lies before the first and after the last, and the library encodes the middle.

A null or empty text has no pieces. A null id is kept. Repeated rows are encoded each. An empty table gives an empty result. Decoding
is exact but for what the format itself can't tell apart (the character U+2581 and a space).
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, materialise, tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
START = (0, "")
State = tuple[int, str]  # characters of the piece before the cut, and the piece
Matrix = dict[tuple[State, State], float]


class Pieces:
    """A model: the library's processor, and its pieces as a lattice needs them."""

    def __init__(self, blob: bytes) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.blob = blob
        self.library = sentencepiece.SentencePieceProcessor(model_proto=blob)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(blob)
        if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces or not proto.normalizer_spec.add_dummy_prefix:
            raise ValueError("only models that leave text as it is, with a space put before it, are handled")
        self.unigram = proto.trainer_spec.model_type == 1
        self.score = {p.piece: p.score for p in proto.pieces if p.type in (1, 4)}
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (1, 4)}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == 2)
        self.longest = max(map(len, self.score))
        self.worst = min(self.score.values()) - 10.0
        self.sure_cuts = all(SPACE not in p[1:] or set(p) == {SPACE} for p in self.score)
        self.pairs: dict[tuple[str, str], bool] = {}

    def __getstate__(self) -> bytes:
        return self.blob

    def __setstate__(self, blob: bytes) -> None:
        self.__init__(blob)

    def merged(self, text: str) -> list[str]:
        """Byte-pair encoding of a short string: the best pair first, the leftmost of equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best = max(((s, -i) for i in range(len(parts) - 1) if (s := score.get(parts[i] + parts[i + 1])) is not None), default=None)
            if best is None:
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def step(self, a: str, b: str) -> float | None:
        """The score of piece b after piece a, or none if they can't be neighbours."""
        own = self.score.get(b, self.worst) if self.unigram else 0.0
        if self.unigram or not a:
            return own if self.unigram or self.merged(b) == [b] else None
        if (good := self.pairs.get((a, b))) is None:
            if len(self.pairs) > 1 << 16:  # a worker keeps the model for its whole life
                self.pairs.clear()
            good = self.pairs[a, b] = self.merged(a + b) == [a, b]
        return own if good else None

    def at(self, text: str, i: int) -> Iterator[str]:
        """The pieces that start here; a character that no piece is counts as one."""
        for n in range(1, min(self.longest, len(text) - i) + 1):
            part = text[i : i + n]
            if part in self.score or n == 1:
                yield part

    def numbers(self, piece: str) -> list[int]:
        if piece in self.ids:
            return [self.ids[piece]]
        return [self.bytes[x] for x in piece.encode()] if self.bytes else [self.unknown]

    def plain(self, text: str) -> list[int]:
        """The library's encoding of an escaped string that starts at a word."""
        return self.library.encode(text[1:].replace(SPACE, " "))


def escaped(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def sure_cuts(text: str, first: int, last: int) -> tuple[int, int] | None:
    """The first and the last word start in text[first:last], if there are two."""
    found = [i for i in (next((i for i in range(max(first, 1), last) if text[i] == SPACE != text[i - 1]), None), next((i for i in range(last - 1, max(first, 1) - 1, -1) if text[i] == SPACE != text[i - 1]), None)) if i is not None]
    return (found[0], found[1]) if len(found) == 2 and found[0] < found[1] else None


def entries(model: Pieces, text: str, cut: int) -> list[State]:
    """The states at a cut: pieces of the text that start before it and end at it or behind."""
    return [(cut - i, p) for i in range(max(0, cut - model.longest), cut) for p in model.at(text, i) if i + len(p) >= cut]


def paths(model: Pieces, text: str, begin: list[tuple[int, str, object]], stop: int, last: int) -> dict[tuple[int, str], dict[object, tuple[float, tuple[int, str] | None]]]:
    """Best scores from each source to each piece. begin: (end of a first piece, the piece, its source); a piece that starts before
    `stop` is followed, and none may end behind `last`. Result: (end, piece) -> source -> (score, (end, piece) before)."""
    found: dict = {}
    due: dict[int, list[tuple[int, str]]] = {}
    for end, piece, source in begin:
        if end > last:
            continue
        if (end, piece) not in found:
            found[end, piece] = {}
            due.setdefault(end, []).append((end, piece))
        found[end, piece][source] = (0.0, None)
    if not due:
        return found
    for i in range(min(due), stop):
        if i not in due:
            continue
        for b in model.at(text, i):
            to = (i + len(b), b)
            if to[0] > last:
                continue
            for node in due[i]:
                if (own := model.step(node[1], b)) is None:
                    continue
                if to not in found:
                    found[to] = {}
                    due.setdefault(to[0], []).append(to)
                for source, (score, _) in found[node].items():
                    if source not in found[to] or found[to][source][0] < score + own:
                        found[to][source] = (score + own, node)
    return found


def transfer(model: Pieces, text: str, first: int, last: int, end: bool) -> Matrix:
    """The matrix of the chunk text[first:last]; the text goes on for a piece's length on both sides. end: it ends at `last`."""
    states = entries(model, text, first) if first else [START]
    begin = [(first - a + len(p), p, (a, p)) for a, p in states]
    is_exit = lambda node: node[0] - len(node[1]) < last <= node[0] and (not end or node[0] == last)
    cuts = sure_cuts(text, first, last) if model.sure_cuts else None
    if not cuts:
        found = paths(model, text, begin, last, len(text))
        return {(source, (last - (node[0] - len(node[1])), node[1])): score for node, row in found.items() if is_exit(node) for source, (score, _) in row.items()}
    a, b = cuts
    head: dict[State, float] = {}
    for node, row in paths(model, text, begin, a, a).items():
        if node[0] == a:
            for source, (score, _) in row.items():
                head[source] = max(head.get(source, score), score)
    tail = {node: row[0][0] for node, row in paths(model, text, [(b, "", 0)], last, len(text)).items() if is_exit(node)}
    # The middle's score is the same for all and left out.
    return {(source, (last - (node[0] - len(node[1])), node[1])): x + y for source, x in head.items() for node, y in tail.items()}


def combine(a: Matrix, b: Matrix) -> Matrix:
    """The max-plus product."""
    rows: dict[State, list[tuple[State, float]]] = {}
    for (m, t), y in b.items():
        rows.setdefault(m, []).append((t, y))
    out: Matrix = {}
    for (s, m), x in a.items():
        for t, y in rows.get(m, ()):
            if (s, t) not in out or out[s, t] < x + y:
                out[s, t] = x + y
    return out


def scan(matrices: list[Matrix]) -> list[State]:
    """The states at all cuts, from the start to the end: prefix products of the start's row, then the best way back."""
    prefixes = [{(START, START): 0.0}]
    for m in matrices:
        prefixes.append(combine(prefixes[-1], m))
    states = [max(prefixes[-1].items(), key=lambda x: (x[1], x[0]))[0][1]]
    for m, before in zip(reversed(matrices), reversed(prefixes[:-1]), strict=True):
        states.append(max(((before[START, s] + x, s) for (s, t), x in m.items() if t == states[-1] and (START, s) in before))[1])
    return states[::-1]


def traced(model: Pieces, text: str, first: int, last: int, entry: State, exit_: State) -> list[int]:
    """The ids of the pieces of one chunk: those after the entry's piece, up to and with the exit's."""

    def back(found: dict, node: tuple[int, str], source: object) -> list[int]:
        out: list[list[int]] = []
        while (before := found[node][source][1]) is not None:
            out.append(model.numbers(node[1]))
            node = before
        return [x for part in reversed(out) for x in part]

    start, goal = first - entry[0] + len(entry[1]), (last - exit_[0] + len(exit_[1]), exit_[1])
    cuts = sure_cuts(text, first, last) if model.sure_cuts else None
    if not cuts:
        return back(paths(model, text, [(start, entry[1], 0)], last, len(text)), goal, 0)
    a, b = cuts
    head = paths(model, text, [(start, entry[1], 0)], a, a)
    joint = max((row[0][0], node) for node, row in head.items() if node[0] == a)[1]
    tail = paths(model, text, [(b, "", 0)], last, len(text))
    return back(head, joint, 0) + model.plain(text[a:b]) + back(tail, goal, 0)


def spans(n: int, chunk: int) -> list[tuple[int, int]]:
    return [(i, min(i + chunk, n)) for i in range(0, n, chunk)]


def encode_by_scan(model: Pieces, text: str, chunk: int) -> list[int]:
    """All steps for one text in one place; what the distributed form does."""
    text = escaped(text)
    cuts = spans(len(text), chunk)
    if not cuts:
        return []
    states = scan([transfer(model, text, a, b, b == len(text)) for a, b in cuts])
    return [x for (a, b), s, t in zip(cuts, states[:-1], states[1:], strict=True) for x in traced(model, text, a, b, s, t)]


def load(path: str) -> Pieces:
    with open(path, "rb") as file:
        return Pieces(file.read())


IDS = "doc_id long, ids array<int>"


def _ids_array(rows: list) -> pa.Array:
    lengths = np.cumsum([0, *map(len, rows)])
    flat = np.concatenate([np.asarray(r, np.int32) for r in rows]) if rows else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(flat))


def _plain(library, batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[list[int]]]]:
    """(ids of documents, their pieces), 256 documents at a time."""
    for i in range(0, batch.num_rows, 256):
        part = batch.slice(i, 256)
        yield part.column(0), library.encode([t or "" for t in part.column(1).to_pylist()], num_threads=1)


def encode(docs: DataFrame, *, model: str = MODEL, chunk: int = 32_768) -> DataFrame:
    """doc_id, ids for each row. The model, half a megabyte, is read on the driver and broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model))
    small, scanned = _encoded(docs, shared, chunk)

    @tidy
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_ids, rows in _plain(shared.value.library, batch):
                yield pa.RecordBatch.from_arrays([doc_ids, _ids_array(rows)], ["doc_id", "ids"])

    return small.mapInArrow(whole, IDS).unionByName(scanned)


def _encoded(docs: DataFrame, shared, chunk: int) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, text) that the library encodes whole, and doc_id, ids of those that are scanned."""
    docs = id_and_text(docs)

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(row, doc_id, k, first, last, end, text): a chunk with a piece's length of what is around it."""
        from pyspark import TaskContext

        task, at, more = TaskContext.get().partitionId(), 0, shared.value.longest
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text, at = escaped(text), at + 1
                for k, (a, b) in enumerate(spans(len(text), chunk)):
                    left = max(0, a - more)
                    row = (f"{task}:{at}", doc_id, k, a - left, b - left, b == len(text), text[left : b + more])
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _CHUNK, strict=True)], _CHUNK_NAMES)

    @tidy
    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            found = [pickle.dumps(transfer(shared.value, text, a, b, end)) for _, _, _, a, b, end, text in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], ["row", "k", "matrix"])

    def scanned(key, group):
        import pandas as pd

        group = group.sort_values("k")
        states = scan([pickle.loads(m) for m in group["matrix"]])
        pairs = [pickle.dumps(x) for x in zip(states[:-1], states[1:], strict=True)]
        return pd.DataFrame({"row": group["row"].to_numpy(), "k": group["k"].to_numpy(), "states": pairs})

    @tidy
    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            ids = [traced(shared.value, text, a, b, *pickle.loads(states)) for _, _, _, a, b, _, text, states in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], _ids_array(ids)], ["row", "doc_id", "k", "ids"])

    length = F.char_length("text")
    small = docs.where(length.isNull() | (length <= chunk))
    chunks = materialise(docs.where(length > chunk).mapInArrow(cut, _CHUNK_SCHEMA).repartition("row", "k"))
    states = chunks.mapInArrow(matrices, "row string, k long, matrix binary").groupBy("row").applyInPandas(scanned, "row string, k long, states binary")
    parts = chunks.join(states, ["row", "k"]).select(*_CHUNK_NAMES, "states").mapInArrow(trace, "row string, doc_id long, k long, ids array<int>")
    joined = parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.flatten(F.sort_array(F.collect_list(F.struct("k", "ids"))).getField("ids")).alias("ids"))
    return small, joined.select("doc_id", "ids")


_CHUNK = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
_CHUNK_NAMES = ["row", "doc_id", "k", "first", "last", "end", "text"]
_CHUNK_SCHEMA = "row string, doc_id long, k long, first long, last long, end boolean, text string"


def decode(encoded: DataFrame, *, model: str = MODEL) -> DataFrame:
    """doc_id, ids, text."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [shared.value.library.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def round_trip(docs: DataFrame, *, model: str = MODEL, chunk: int = 32_768) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit numbers), decoded_sha256 (of the text that the ids decode
    to), ids."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model))
    small, scanned = _encoded(docs, shared, chunk)

    def back(doc_ids: pa.Array, ids: list[np.ndarray]) -> pa.RecordBatch:
        library = shared.value.library
        texts = [library.decode(x.tolist()) for x in ids]
        digests = [[hashlib.sha256(d).hexdigest() for d in data] for data in ((x.astype("<i4").tobytes() for x in ids), (t.encode() for t in texts))]
        return pa.RecordBatch.from_arrays([doc_ids, pa.array([len(x) for x in ids], pa.int64()), *map(pa.array, digests), _ids_array(ids)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])

    # Encoding and decoding in one operator: two would be two workers a task.
    @tidy
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_ids, rows in _plain(shared.value.library, batch):
                yield back(doc_ids, [np.array(x, np.int32) for x in rows])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 16):
                part = batch.slice(i, 16)
                yield back(part.column(0), [np.asarray(x.values, np.int32) for x in part.column(1)])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>"
    return small.mapInArrow(whole, schema).unionByName(scanned.mapInArrow(run, schema))
