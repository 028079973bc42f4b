"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits have a common variant: one within r bits of both. So every distinct fingerprint
emits all its variants within r bits, variants are brought together by a shuffle, and whoever meets on a variant is a candidate,
verified by its distance.

A 64-bit fingerprint has 2081 variants within 2 bits. They travel packed: a variant goes to the group given by its first `k` bits
(k follows the number of fingerprints), and all variants of a fingerprint that share those bits are one row, (fingerprint, flips
left), from which the group makes the variants in memory. With k = 12 that is 79 short rows instead of 2081. A group that holds
more than `room` variants splits itself on further bits in the same way, as often as needed, so memory is bounded however alike
the fingerprints are. On a variant all are linked to the smallest (any two of them are within 2r bits of each other), and a group
passes on a spanning forest only; a ball of n near copies gives n - 1 links, not all pairs.

Components come from alternating large-star and small-star steps, each a written table.

`similar_groups` uses the same on several shorter fingerprints at once, for documents that are alike but not almost the same.

Null and empty texts have no words: fingerprint zero, linked like any other. Null ids are allowed, and sort after all others;
repeated rows are one fingerprint, and so are in one component; of a group exactly one row stays, whatever ids repeat. A text of any
length is read whole. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, materialise, text_bytes, tidy, told_apart, without

SEED = 42
BITS = 64
ONE = np.uint64(1)


def shingle_hashes(data: bytes, words: int) -> np.ndarray:
    """XXH64 of every run of `words` words (of all words if there are fewer), lower-cased in A-Z, joined by one space."""
    parts = data.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(parts) - words + 1)
    last = ends[words - 1 :] if len(parts) >= words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    votes = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 255 * 64):
        part = hashes[i : i + 255 * 64]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8)).reshape(-1, BITS)
        if len(bits) % 255:
            bits = np.vstack([bits, np.zeros((-len(bits) % 255, BITS), np.uint8)])
        # Eight counters in a word: 255 rows of zeros and ones can't overflow a byte.
        votes += bits.reshape(-1, 255, BITS).view(np.uint64).sum(1).view(np.uint8).reshape(-1, BITS).sum(0, dtype=np.int64)
    return int("".join("1" if 2 * v > len(hashes) else "0" for v in votes), 2)


def simhash(data: bytes, words: int = 4) -> int:
    return majority(shingle_hashes(data, words))


def fingerprints(docs: DataFrame, *, words: int = 4) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((simhash(x, words) for x in text_bytes(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, fp long")


def flips(bits: list[int], most: int) -> list[np.ndarray]:
    """For each number of flips up to `most`, the masks that flip so many of these bits."""
    return [np.array([sum(1 << b for b in c) for c in combinations(bits, n)] or [], np.uint64) for n in range(most + 1)]


def spread(fps: np.ndarray, masks: np.ndarray, left: np.ndarray, bits: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows (group, fingerprint, mask, flips left): every way to flip at most `left` of these bits; the group is the value that
    the bits then have."""
    f, m, rest = [], [], []
    for n, table in enumerate(flips(bits, int(left.max(initial=0)))):
        own = left >= n
        if len(table) and own.any():
            f.append(np.repeat(fps[own], len(table)))
            m.append((masks[own][:, None] ^ table[None, :]).ravel())
            rest.append(np.repeat(left[own] - n, len(table)))
    f, m, rest = np.concatenate(f), np.concatenate(m), np.concatenate(rest)
    group = np.zeros(len(f), np.int64)
    for b in bits:
        group = group << 1 | ((f ^ m) >> np.uint64(b) & ONE).astype(np.int64)
    return group, f, m, rest


class Forest:
    """Links between fingerprints; keeps a spanning forest."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def link(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def meet(fps: np.ndarray, masks: np.ndarray, left: np.ndarray, free: list[int], radius: int, room: int, forest: Forest) -> None:
    """Links all fingerprints that meet on a variant. free: the bits that may still flip; masks: the flips so far."""
    if len(fps) < 2:
        return
    counts = [sum(len(m) for m in flips(free, n)) for n in range(radius + 1)]
    if free and sum(np.bincount(left, minlength=radius + 1)[: radius + 1] * np.array(counts)) > room and len(fps) > 64:
        now, rest = free[:4], free[4:]
        group, f, m, few = spread(fps, masks, left, now)
        order = np.argsort(group, kind="stable")
        cuts = np.flatnonzero(np.diff(group[order])) + 1
        for part in np.split(order, cuts):
            meet(f[part], m[part], few[part], rest, radius, room, forest)
        return
    variants, owners = [], []
    for n, table in enumerate(flips(free, radius)):
        own = left >= n
        if len(table) and own.any():
            variants.append(((fps ^ masks)[own][:, None] ^ table[None, :]).ravel())
            owners.append(np.repeat(np.flatnonzero(own).astype(np.int32), len(table)))
    variant, owner = np.concatenate(variants), np.concatenate(owners)
    order = np.argsort(variant)
    variant, owner = variant[order], owner[order]
    hit = np.flatnonzero(variant[1:] == variant[:-1])
    if len(hit):
        a, b = fps[owner[hit]], fps[owner[hit + 1]]
        near = (a != b) & (np.bitwise_count(a ^ b) <= 2 * radius)
        pairs = np.unique(np.stack([np.minimum(a, b)[near], np.maximum(a, b)[near]], 1), axis=0)
        for x, y in pairs.tolist():
            forest.link(x, y)


def links(prints: DataFrame, *, distance: int = 4, group_rows: int = 512, room: int = 1 << 21) -> DataFrame:
    """(u, v), v < u as signed longs: links that join whatever is within `distance` bits. prints: distinct `fp`."""
    if distance % 2:
        raise ValueError("an odd distance has no middle")
    radius = distance // 2
    n = prints.count()
    k = min(20, max(4, int(np.ceil(np.log2(max(1, n / group_rows))))))
    first = list(range(BITS - 1, BITS - 1 - k, -1))
    rest = list(range(BITS - k))

    @tidy
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(fps), 4096):
                part = fps[i : i + 4096]
                group, f, _, left = spread(part, np.zeros(len(part), np.uint64), np.full(len(part), radius), first)
                yield pa.RecordBatch.from_arrays([pa.array(group.astype(np.int32)), pa.array(f.view(np.int64)), pa.array(left.astype(np.int8))], ["g", "fp", "flips_left"])

    @tidy
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group."""
        forest, group, held = Forest(), None, []

        def close() -> None:
            if held:
                f, left = (np.concatenate(x) for x in zip(*held, strict=True))
                # The first bits are the group's: with them set, what is left to flip are the other bits.
                mask = np.uint64(((1 << k) - 1) << (BITS - k))
                masks = (f & mask) ^ np.uint64(group << (BITS - k))
                meet(f, masks, left, rest, radius, room, forest)
                held.clear()

        for batch in batches:
            g, f, left = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for part in np.split(np.arange(len(g)), np.flatnonzero(np.diff(g)) + 1):
                if len(part):
                    if group != int(g[part[0]]):
                        close()
                        group = int(g[part[0]])
                    held.append((f[part].view(np.uint64), left[part].astype(np.int64)))
        close()
        items = np.array([(u, forest.root(u)) for u in list(forest.up)], np.uint64).reshape(-1, 2).view(np.int64)
        for i in range(0, len(items), 10000):
            part = items[i : i + 10000]
            yield pa.RecordBatch.from_arrays([pa.array(part.max(1)), pa.array(part.min(1))], ["u", "v"])

    rows = prints.select("fp").mapInArrow(emit, "g int, fp long, flips_left byte")
    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(join, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of an edge list (u, v) reaches; roots are left out.

    Large-star: what is larger than a node goes to the smallest of its neighbours. Small-star: what isn't larger does. Both
    keep the components; when they change nothing, every node is tied to its root. The smallest neighbour is a plain minimum,
    combined before the shuffle, and a hub's join can be split, so a hub is no single task's."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("c", "m").alias("m"))
        joined = both.join(least, both.u == least.c)
        if large:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
        return out.where("u != v").distinct()

    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    edges = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
    was = state(edges)
    while True:
        edges = materialise(star(star(edges, True), False))
        now = state(edges)
        if now == was:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        was = now


def near_groups(docs: DataFrame, *, words: int = 4, distance: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest id that is linked to it, itself included)."""
    prints = materialise(fingerprints(docs, words=words))
    ids = F.min("doc_id").alias("least"), F.count("*").alias("n")
    distinct = materialise(prints.groupBy("fp").agg(*ids))
    tied = components(links(distinct, distance=distance))
    rooted = materialise(distinct.join(tied, distinct.fp == tied.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")))
    # Only fingerprints that several documents or an edge share need a look-up; the others stand for themselves. Written, so that the
    # join on a root that a third of all have is of two plain exchanges, which Spark splits.
    least = materialise(rooted.groupBy("root").agg(F.min("least").alias("component"), F.sum("n").alias("size")).where("size > 1"))
    found = materialise(rooted.join(least, "root").select(F.col("fp").alias("f"), "component"))
    joined = prints.join(found, prints.fp == found.f, "left")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component", "doc_id").alias("component_id"))


def turned(similarity: float) -> float:
    """The share of bits that differ between the fingerprints of two shingle sets of this Jaccard similarity."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def tables_for(n: int, similarity: float, distance: int, recall: float, group_rows: int = 1 << 18) -> tuple[int, int, int]:
    """(bits of a table, its first bits that must be equal, tables). Bits grow with the number of documents, so that chance meetings of
    a document stay few, and the first bits so that a group of documents that share them has about `group_rows`. Tables then suffice
    for `recall` of the pairs of this similarity to share the first bits and be within `distance` bits in one of them: a few tables
    more, but a document travels once a table, whatever its number, not once for each way to flip the first bits."""
    bits = int(min(64, max(24, np.ceil(np.log2(max(2, n))) + 14)))
    first = int(min(16, max(2, np.ceil(np.log2(max(1, n / group_rows))))))
    p, hit, term = turned(similarity), 0.0, (1 - turned(similarity)) ** bits
    for k in range(distance + 1):
        hit += term
        term *= (bits - first - k) / (k + 1) * p / (1 - p)
    return bits, first, int(np.ceil(np.log(1 - recall) / np.log(1 - hit)))


def wide_simhash(data: bytes, words: int, size: int) -> bytes:
    """`size` fingerprints of 64 bits, from as many mixtures of the shingle hashes: one row of bits, of which tables take theirs."""
    hashes, out = shingle_hashes(data, words), []
    with np.errstate(over="ignore"):
        for t in range(size):
            x = (hashes + np.uint64(t * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            out.append(majority(x ^ (x >> np.uint64(29))))
    return np.array(out, "<u8").tobytes()


def bits_at(wide: np.ndarray, start: int, bits: int) -> np.ndarray:
    """The `bits` bits from `start` on of each row of 64-bit words."""
    word, at = divmod(start, BITS)
    out = wide[:, word] << np.uint64(at)
    if at + bits > BITS:
        out = out | wide[:, word + 1] >> np.uint64(BITS - at)
    return out >> np.uint64(BITS - bits)


class Crowds:
    """Nodes by their fingerprint in one table (`values`, distinct; the nodes of value i are `start[i]` and the next `count[i]`),
    and what joins them: whole fingerprints that differ in at most `most` bits. What is joined already isn't judged again."""

    def __init__(self, fps: np.ndarray, wide: np.ndarray, names: np.ndarray, most: int, forest: Forest) -> None:
        order = np.argsort(fps, kind="stable")
        self.values, self.start, self.count = np.unique(fps[order], return_index=True, return_counts=True)
        self.wide, self.names, self.most, self.forest = wide[order], names[order], most, forest
        others = np.ones(len(order), bool)
        others[self.start] = False
        self.judge(np.flatnonzero(others), np.repeat(self.start, self.count)[others])

    def judge(self, a: np.ndarray, b: np.ndarray) -> None:
        """Pair by pair."""
        for i in range(0, len(a), 1 << 17):
            x, y = a[i : i + (1 << 17)], b[i : i + (1 << 17)]
            near = np.bitwise_count(self.wide[x] ^ self.wide[y]).sum(1, dtype=np.int64) <= self.most
            for u, v in zip(self.names[x[near]].tolist(), self.names[y[near]].tolist(), strict=True):
                self.forest.link(u, v)

    def roots(self, at: np.ndarray) -> np.ndarray:
        root = self.forest.root
        return np.array([root(x) for x in self.names[at].tolist()], np.int64)

    def signs(self, at: np.ndarray) -> np.ndarray:
        rows = np.ascontiguousarray(self.wide[at])
        return np.unpackbits(rows.view(np.uint8).reshape(len(rows), -1), axis=1).astype(np.float32) * 2 - 1

    def cross(self, a: np.ndarray, b: np.ndarray) -> None:
        """All of a with all of b, in blocks: a few are tried first, which joins a crowd of near copies, then whoever isn't joined.
        The product of two rows of signs is their number of bits less twice those that differ."""
        for x in a[:: max(1, len(a) // 4)][:4]:
            self.judge(np.full(len(b), x), b)
        for y in b[:: max(1, len(b) // 4)][:4]:
            self.judge(a, np.full(len(a), y))
        ra, rb = self.roots(a), self.roots(b)
        a = a[np.argsort(ra, kind="stable")]
        for i in range(0, len(a), 512):
            x = a[i : i + 512]
            rx = self.roots(x)
            y = b if rx[0] != rx[-1] else b[rb != rx[0]]
            if not len(y):
                continue
            left = self.signs(x)
            for j in range(0, len(y), 2048):
                part = y[j : j + 2048]
                right = self.signs(part)
                p, q = np.nonzero(left @ right.T >= left.shape[1] - 2 * self.most)
                apart = self.roots(x)[p] != self.roots(part)[q]
                for u, v in zip(self.names[x[p[apart]]].tolist(), self.names[part[q[apart]]].tolist(), strict=True):
                    self.forest.link(u, v)
            rb = self.roots(b)

    def members(self, i: int) -> np.ndarray:
        return np.arange(self.start[i], self.start[i] + self.count[i])

    def meet_self(self, own: np.ndarray) -> None:
        """All pairs under each of these values."""
        for i in own[self.count[own] > 2].tolist():
            self.cross(self.members(i), self.members(i))

    def meet_pairs(self, i: np.ndarray, j: np.ndarray) -> None:
        """All pairs of a node under value i and one under value j."""
        sizes = self.count[i] * self.count[j]
        for x, y in zip(i[sizes > 4096].tolist(), j[sizes > 4096].tolist(), strict=True):
            self.cross(self.members(x), self.members(y))
        i, j, sizes = i[sizes <= 4096], j[sizes <= 4096], sizes[sizes <= 4096]
        for part in _stretches(sizes, 1 << 18):
            n, cj = sizes[part], np.repeat(self.count[j[part]], sizes[part])
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            self.judge(np.repeat(self.start[i[part]], n) + k // cj, np.repeat(self.start[j[part]], n) + k % cj)

    def labels(self, values: np.ndarray) -> np.ndarray:
        """The root of each value's nodes, or a number of its own if they have several."""
        size = self.count[values]
        first = np.cumsum(size) - size
        roots = self.roots(np.repeat(self.start[values] - first, size) + np.arange(size.sum()))
        mixed = np.minimum.reduceat(roots, first) != np.maximum.reduceat(roots, first)
        ids = np.unique(roots[first], return_inverse=True)[1]
        return np.where(mixed, len(ids) + np.arange(len(ids)), ids)


def _stretches(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Slices whose sizes add up to about `most`."""
    if len(sizes):
        cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // most)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)], strict=True):
            yield slice(a, b)


def meeting_place(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Of the variants within `radius` bits of both the one where the pair is judged: the smaller fingerprint, or, if that is too
    far from the other, it with the lowest `radius` bits flipped that differ."""
    at, rest = np.minimum(a, b), a ^ b
    far = np.bitwise_count(rest) > radius
    for _ in range(radius):
        bit = rest & (~rest + ONE)
        at = np.where(far, at ^ bit, at)
        rest = rest ^ bit
    return at


def meet_wide(crowds: Crowds, at: np.ndarray, masks: np.ndarray, left: np.ndarray, free: list[int], radius: int, room: int) -> None:
    """As `meet`, for one table of wide fingerprints: who meets is linked if the whole fingerprints differ in at most `most` bits.
    at: the values that are here. On a variant each is compared with the one beside it and with the first; of whom that leaves
    apart, all pairs are judged, each pair at its meeting place only."""
    fps = crowds.values[at]
    if len(fps) < 2:
        return
    counts = [sum(len(m) for m in flips(free, n)) for n in range(radius + 1)]
    if free and sum(np.bincount(left, minlength=radius + 1)[: radius + 1] * np.array(counts)) > room and len(fps) > 64:
        # One value of the next four bits after the other: what it takes to get there is so many flips less. `free` falls or rises.
        now, rest = free[:4], free[4:]
        low = np.uint64(min(now))
        for value in range(1 << len(now)):
            turn = (((fps ^ masks) >> low) & np.uint64((1 << len(now)) - 1)) ^ np.uint64(value)
            left_then = left - np.bitwise_count(turn).astype(np.int64)
            can = np.flatnonzero(left_then >= 0)
            meet_wide(crowds, at[can], masks[can] ^ (turn[can] << low), left_then[can], rest, radius, room)
        return
    variants, owners = [], []
    for n, table in enumerate(flips(free, radius)):
        own = left >= n
        if len(table) and own.any():
            variants.append(((fps ^ masks)[own][:, None] ^ table[None, :]).ravel())
            owners.append(np.repeat(at[own].astype(np.int32), len(table)))
    variant, owner = np.concatenate(variants), np.concatenate(owners)
    del variants, owners
    order = np.argsort(variant)
    variant, owner = variant[order], owner[order].astype(np.int64)
    same = np.concatenate(([False], variant[1:] == variant[:-1]))
    hit = np.flatnonzero(same)
    if not len(hit):
        return
    start = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
    a, b = np.concatenate([owner[hit], owner[hit]]), np.concatenate([owner[hit - 1], owner[start[hit]]])
    # Three nodes on a variant are judged by that, more aren't.
    nodes = np.bincount(start, weights=crowds.count[owner], minlength=len(same))[start]
    crowded = (nodes > 3) & (same | np.append(same[1:], False))
    n = len(crowds.values)
    pairs = np.unique(np.minimum(a, b) * n + np.maximum(a, b))
    crowds.judge(crowds.start[pairs // n], crowds.start[pairs % n])
    del a, b, pairs, start, nodes
    if not crowded.any():
        return
    # Whoever shares a variant, by what they are joined to: only pairs across such runs are open.
    variant, owner = variant[crowded], owner[crowded]
    there, label = np.unique(owner, return_inverse=True)
    label = crowds.labels(there)[label]
    order = np.lexsort((label, variant))
    variant, owner, label = variant[order], owner[order], label[order]
    edge = np.flatnonzero(variant[1:] != variant[:-1]) + 1
    turn = np.flatnonzero((variant[1:] != variant[:-1]) | (label[1:] != label[:-1])) + 1
    place = np.arange(len(variant))
    bucket_end = np.append(edge, len(variant))[np.searchsorted(edge, place, side="right")]
    run_end = np.append(turn, len(variant))[np.searchsorted(turn, place, side="right")]
    open_pairs = bucket_end - run_end
    for part in _stretches(open_pairs, 1 << 18):
        size = open_pairs[part]
        p = np.repeat(place[part], size)
        q = np.repeat(run_end[part], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        here = meeting_place(crowds.values[owner[p]], crowds.values[owner[q]], radius) == variant[p]
        crowds.meet_pairs(owner[p[here]], owner[q[here]])


def wide_links(prints: DataFrame, *, bits: int, first: int, tables: int, size: int, judged: int, most: int, distance: int = 4, room: int = 1 << 18) -> DataFrame:
    """(u, v): links between nodes whose wide fingerprints share the first bits of one table, are within `distance` bits in it, and
    within `most` in the first `judged` words. prints: (node, wide), distinct; wide has `size` words. A row a node and table travels."""
    radius = distance // 2
    rest = list(range(bits - first))

    @tidy
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                wide = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u8").reshape(-1, size)
                shown = pa.array([row.tobytes() for row in wide[:, :judged]], pa.binary())
                for t in range(tables):
                    fp = bits_at(wide, t * bits, bits)
                    group = (fp >> np.uint64(bits - first)).astype(np.int64) | t << first
                    yield pa.RecordBatch.from_arrays([pa.array(group.astype(np.int32)), part.column(0), pa.array(fp.view(np.int64)), shown], ["g", "node", "fp", "wide"])

    @tidy
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, group, held = Forest(), None, []

        def close() -> None:
            if held:
                nodes, fps, wide = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                crowds = Crowds(fps, wide, nodes, most, forest)
                at = np.arange(len(crowds.values))
                crowds.meet_self(at)
                meet_wide(crowds, at, np.zeros(len(at), np.uint64), np.full(len(at), radius), rest, radius, room)

        for batch in batches:
            g, nodes, fps = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2))
            wide = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<u8").reshape(-1, judged)
            for part in np.split(np.arange(len(g)), np.flatnonzero(np.diff(g)) + 1):
                if len(part):
                    if group != int(g[part[0]]):
                        close()
                        group = int(g[part[0]])
                    held.append((nodes[part], fps[part].view(np.uint64), wide[part]))
        close()
        items = np.array([(u, forest.root(u)) for u in list(forest.up)], np.int64).reshape(-1, 2)
        for i in range(0, len(items), 10000):
            part = items[i : i + 10000]
            yield pa.RecordBatch.from_arrays([pa.array(part.max(1)), pa.array(part.min(1))], ["u", "v"])

    rows = prints.select("node", "wide").mapInArrow(emit, "g int, node long, fp long, wide binary")
    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(join, "u long, v long")


def _similar(docs: DataFrame, *, words: int = 5, similarity: float = 0.8, recall: float = 0.99, slack: float = 0.03, judged: int = 320) -> DataFrame:
    """docs: doc_id, row_file, row_line, text. The first three of each row, and component: of each group of several rows, linked by an
    estimated Jaccard similarity of shingle sets of `similarity` or more, the first row, (without id, doc_id, row_file, row_line).

    At 0.8, two 64-bit fingerprints differ in some ten bits, too many for balls. So there are several shorter fingerprints, as
    `tables_for` says; documents meet by ball hashing in any, and a pair is judged by the first `judged` bits of all, in whole
    words. `slack` is what the estimate may lack."""
    n = docs.count()
    bits, first, tables = tables_for(n, similarity, 4, recall)
    seen = -(-judged // BITS)
    size = max(seen, -(-tables * bits // BITS))
    most = round(turned(similarity - slack) * BITS * seen)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = [wide_simhash(x, words, size) for x in text_bytes(batch.column(3))]
            node = np.array([xxhash.xxh64_intdigest(w, SEED) for w in wide], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(node), pa.array(wide, pa.binary())], ["doc_id", "row_file", "row_line", "node", "wide"])

    prints = materialise(docs.select("doc_id", "row_file", "row_line", "text").mapInArrow(run, "doc_id long, row_file long, row_line long, node long, wide binary"))
    distinct = prints.groupBy("node").agg(F.first("wide").alias("wide"))
    order = F.struct(F.col("doc_id").isNull().alias("a"), "doc_id", "row_file", "row_line")
    least = materialise(prints.groupBy("node").agg(F.min(order).alias("least"), F.count("*").alias("n")))
    tied = components(wide_links(distinct, bits=bits, first=first, tables=tables, size=size, judged=seen, most=most)).withColumnRenamed("node", "tied")
    rooted = materialise(least.join(tied, F.col("node") == F.col("tied"), "left").select("node", "least", "n", F.coalesce("root", "node").alias("root")))
    # Written, so that joins on a root or a fingerprint that a third of all have are of plain exchanges, which Spark splits.
    groups = materialise(rooted.groupBy("root").agg(F.min("least").alias("component"), F.sum("n").alias("size")).where("size > 1"))
    found = materialise(rooted.join(groups, "root").select(F.col("node").alias("f"), "component"))
    return prints.join(found, F.col("node") == F.col("f"), "left").select("doc_id", "row_file", "row_line", "component")


def similar_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, component_id (the smallest id of the document's group; see `_similar`)."""
    return _similar(told_apart(docs, id_col, text_col)[0], **options).select("doc_id", F.coalesce("component.doc_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs`, all columns, of which of each group of similar documents one stays: that with the smallest id (a null id sorts
    after all others), and of such rows the first."""
    slim, docs, file, line = told_apart(docs, id_col, text_col)
    stays = F.col("component").isNull() | ((F.col("row_file") == F.col("component.row_file")) & (F.col("row_line") == F.col("component.row_line")))
    return without(docs, _similar(slim, **options).where(~stays), file, line)
