"""Extractive compression: a similarity graph of blocks, its ranks, greedy coverage, and the choice of lines to leave out.

Statistics and the graph are plans over all documents at once. Greedy coverage and the choice of lines are sequential by nature and
run in one Python call a document, whose lines a row has held anyway."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import without_number
from .inside import best_of, grouped, ranks_of_blocks, scores_of_units, words
from .lexical import corpus_size, knee, postings, term_stats

LINES_A_BLOCK = 8


def blocks(docs: DataFrame, doc: str = "doc_id", text: str = "text", size: int = LINES_A_BLOCK) -> DataFrame:
    """(doc_id, block, first, last, text): an exact partition of the lines into runs of equal length."""
    rows = docs.select(F.col(doc).alias("doc_id"), F.posexplode(F.split(F.col(text), "\n")).alias("i", "text"))
    grouped = rows.groupBy("doc_id", F.floor(F.col("i") / size).cast("int").alias("block"))
    return grouped.agg((F.min("i") + 1).alias("first"), (F.max("i") + 1).alias("last"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), "\n").alias("text"))


def weighted_postings(units: DataFrame, by: tuple[str, ...], k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(by..., doc, term, df, n, eidf, w): postings of tokenised units with their weights."""
    every = postings(units, None, by)
    stats = term_stats(every, corpus_size(units, by), by)
    top = F.max("idf").over(Window.partitionBy(*by))
    stats = stats.withColumn("eidf", F.col("idf") * (1 + F.when(top > 0, F.col("idf") / top).otherwise(F.col("idf")) * F.col("info")))
    joined = every.join(stats, [*by, "term"])
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return joined.select(*by, "doc", "term", "df", "n", "eidf", (F.col("eidf") * tf).alias("w"))


def similarity_edges(weights: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by..., a, b, sim), a < b: cosines of units, without terms that are too common or too faint to tell, down to 1 % of the largest.
    Norms are of all terms. The limits on how many units a term may be in are part of the measure; within a document they also keep
    the pairs few."""
    norms = weights.where("eidf > 0").groupBy(*by, "doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    whole = Window.partitionBy(*by)
    n = F.col("n")
    floor_ = F.max("eidf").over(whole) * F.when(n > 5000, 0.05).when(n > 1000, 0.02).otherwise(0.005)
    most = F.when(n > 5000, F.floor(n / 10)).when(n > 1000, F.floor(n / 5)).otherwise(F.greatest(F.floor(n / 2), F.lit(10)))
    kept = weights.withColumn("least", floor_).where((F.col("eidf") >= F.col("least")) & (F.col("df") >= 2) & (F.col("df") <= most))
    a = kept.select(*by, "term", F.col("doc").alias("a"), F.col("w").alias("wa"))
    b = kept.select(*by, "term", F.col("doc").alias("b"), F.col("w").alias("wb"))
    raw = a.join(b, [*by, "term"]).where("a < b").groupBy(*by, "a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    na, nb = norms.select(*by, F.col("doc").alias("a"), F.col("norm").alias("na")), norms.select(*by, F.col("doc").alias("b"), F.col("norm").alias("nb"))
    sims = raw.join(na, [*by, "a"]).join(nb, [*by, "b"]).withColumn("sim", F.col("dot") / (F.col("na") * F.col("nb"))).where("sim > 0")
    return sims.withColumn("top", F.max("sim").over(whole)).where("sim >= 0.01 * top").select(*by, "a", "b", "sim")


def keywords(weights: DataFrame, by: tuple[str, ...], most: int = 10) -> DataFrame:
    """(by..., term, weight, rank): the terms of largest eidf times root of df."""
    terms = weights.where("eidf > 0").groupBy(*by, "term").agg(F.max(F.col("eidf") * F.sqrt("df")).alias("weight"))
    order = Window.partitionBy(*by).orderBy(F.desc(F.round("weight", 9)), "term")
    return terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def document_ranks(edges: DataFrame, units: DataFrame, *, damping: float = 0.85, rounds: int = 50, epsilon: float = 1e-6) -> DataFrame:
    """(doc_id, doc, rank): the rank of each unit in its document's graph. Many small graphs: each is walked in one call, where a plan
    would join all of them once a round."""
    import numpy as np
    import pandas as pd

    def walk(batches):
        for batch in batches:
            parts = []
            for key, ids, links in zip(batch["doc_id"], batch["ids"], batch["links"], strict=True):
                at, n = {int(x): i for i, x in enumerate(ids)}, len(ids)
                links = [] if links is None else links
                a, b = (np.array([at[x[c]] for x in links], np.int64) for c in ("a", "b"))
                src, dst, w = np.concatenate([a, b]), np.concatenate([b, a]), np.array([x["sim"] for x in links] * 2, np.float64)
                total, p, rank = np.bincount(src, w, n), np.full(n, 1 / n), np.full(n, 1 / n)
                for _ in range(rounds):
                    new = (1 - damping) * p + damping * rank[total == 0].sum() * p + damping * np.bincount(dst, rank[src] * w / total[src], n)
                    moved, rank = np.abs(new - rank).sum(), new
                    if moved < epsilon:
                        break
                parts.append(pd.DataFrame({"doc_id": key, "doc": list(at), "rank": rank}))
            yield pd.concat(parts)

    nodes = units.groupBy("doc_id").agg(F.sort_array(F.collect_list("doc")).alias("ids"))
    links = edges.groupBy("doc_id").agg(F.collect_list(F.struct("a", "b", "sim")).alias("links"))
    return nodes.join(links, "doc_id", "left").mapInPandas(walk, "doc_id long, doc int, rank double")


def covered(ranked: list[tuple[int, float]], terms: dict[int, dict[str, float]], weight: float = 0.5) -> list[int]:
    """Units in the order in which each next brings the most: its rank, partly by how much of its terms is new."""
    seen: set[str] = set()
    rest, out = dict(sorted(ranked)), []
    while rest:
        best, top = None, -1.0
        for unit, rank in rest.items():
            own = terms.get(unit, {})
            total = sum(own.values())
            new = sum(w for t, w in own.items() if t not in seen) / total if total > 0 else 0.0
            if (score := rank * (weight + (1 - weight) * new)) > top:
                best, top = unit, score
        del rest[best]
        seen.update(terms.get(best, {}))
        out.append(best)
    return out


def coverage_order(ranks: DataFrame, weights: DataFrame) -> DataFrame:
    """(doc_id, doc, position) of every unit."""
    import pandas as pd

    def order(batches):
        for batch in batches:
            parts = []
            for key, ranked, words in zip(batch["doc_id"], batch["ranked"], batch["words"], strict=True):
                terms: dict[int, dict[str, float]] = {}
                for x in [] if words is None else words:
                    terms.setdefault(x["doc"], {})[x["term"]] = x["eidf"]
                found = covered([(x["doc"], x["rank"]) for x in ranked], terms)
                parts.append(pd.DataFrame({"doc_id": key, "doc": found, "position": range(len(found))}))
            yield pd.concat(parts)

    ranked = ranks.groupBy("doc_id").agg(F.collect_list(F.struct("doc", "rank")).alias("ranked"))
    words = weights.where("eidf > 0").groupBy("doc_id").agg(F.collect_list(F.struct("doc", "term", "eidf")).alias("words"))
    return ranked.join(words, "doc_id", "left").mapInPandas(order, "doc_id long, doc int, position int")


def core_units(ranks: DataFrame) -> DataFrame:
    """(doc_id, doc): the units up to the knee of the ranks."""
    size = knee(ranks.select("doc_id", "doc", F.round("rank", 12).alias("score")), ("doc_id",), ("doc",))
    w = Window.partitionBy("doc_id").orderBy(F.desc("rank"), "doc")
    return ranks.withColumn("k", F.row_number().over(w)).join(size, "doc_id").where("k <= core").select("doc_id", "doc")


def blocks_of(lines: list[list[str]], size: int = LINES_A_BLOCK) -> list[list[str]]:
    """The tokens of each block, of the tokens of each line."""
    return [[t for line in lines[i : i + size] for t in line] for i in range(0, len(lines), size)]


def coverage(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, doc, position) of every block, as `coverage_order` of `blocks`. The texts travel, to bring those of one id together."""
    kind = docs.schema[doc].dataType

    def run(batches):
        for held in grouped(batches):
            lines = [[words(line) for line in texts[0].split("\n")] for _, texts in held]
            for own, (_, texts) in zip(lines, held, strict=True):
                if len(texts) > 1:  # rows of one id: their lines side by side
                    parts = [[words(line) for line in x.split("\n")] for x in texts]
                    own[:] = [[t for x in parts if i < len(x) for t in x[i]] for i in range(max(map(len, parts)))]
            ids, blocks_, places = [], [], []
            for (key, _), (ranks, terms) in zip(held, ranks_of_blocks([blocks_of(x) for x in lines]), strict=True):
                found = covered(list(enumerate(ranks)), terms)
                ids += [key] * len(found)
                blocks_ += found
                places += range(len(found))
            yield pa.RecordBatch.from_arrays([pa.array(ids, to_arrow_type(kind)), pa.array(blocks_, pa.int32()), pa.array(places, pa.int32())], ["doc_id", "doc", "position"])

    rows = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    return rows.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(run, f"doc_id {kind.simpleString()}, doc int, position int")


SHORTEST = 6


def marker_size(first: int, last: int) -> int:
    return len(f"[TRUNCATED: lines {first}-{last}]")


def choose_drops(weights: list[int], eligible: list[bool], low: int, high: int, first_line: int = 1, room: int = 1 << 28) -> tuple[list[tuple[int, int]], int, bool]:
    """Runs (start, end) of lines to leave out, what that saves (their sizes less their markers'), and if it is within low..high.

    Runs have six lines at least, as have the kept stretches between two of them, and only eligible lines. Of all choices that save
    at least `low` and at most `high` the one that saves least; if there is none, nothing is dropped.

    Position i of the scan knows, as bits of one integer each, the savings that are reachable with line i kept (`free`) and with a run
    just ended before it (`ended`); a run that starts at s and ends at e shifts what was free at s by its saving. Savings within a
    run grow by one line's size at a time, so runs are carried as a shifted set for all of their starts together: by how many digits
    their first line has, as only that tells their markers apart. Sizes are made coarser by a common divisor when the sets would
    outgrow `room` bits; the choice is then checked with the exact sizes."""
    n = len(weights)
    if not any(eligible) or high < low or high < 0:
        return [], 0, low <= 0 <= high
    unit = max(1, -(-(high + 64) * n // room))
    cost = [w // unit if unit > 1 else w for w in weights]
    base = marker_size(0, 0) - 2
    digits = [len(str(first_line + i)) for i in range(n)]
    # Savings can be below zero for a while (a marker before its lines), never by more than a marker's size.
    zero = base + 2 * max(digits) + 1
    # A run on its way holds its marker's size more than it will save.
    mask = (1 << (2 * zero + high // unit + 1)) - 1
    prefix = [0]
    for w in cost:
        prefix.append(prefix[-1] + w)
    longest_ok = [0] * (n + 1)
    for i in range(n):
        longest_ok[i + 1] = longest_ok[i] + 1 if eligible[i] else 0
    # start[i]: savings with which a run may start at line i: nothing dropped yet, or six kept lines since the last run.
    done = [0] * (n + 1)  # done[i]: savings with a run that ends exactly before line i
    start = [0] * (n + 1)
    clear = 1 << zero
    settled = 0  # savings of runs that ended six lines ago or more
    running: dict[int, int] = {}  # by digits of the first line: savings so far, of runs of six lines or more that go on
    for i in range(n + 1):
        if i - SHORTEST >= 0:
            settled |= done[i - SHORTEST]
        start[i] = clear | settled
        if i:
            for d in list(running):  # line i - 1 joins the runs that go on
                running[d] = running[d] << cost[i - 1] & mask if eligible[i - 1] else 0
            if longest_ok[i] >= SHORTEST:
                s = i - SHORTEST
                shift = prefix[i] - prefix[s]
                moved = start[s] << shift & mask
                running[digits[s]] = running.get(digits[s], 0) | moved
            for d, bits in running.items():
                fee = (base + d + digits[i - 1]) // unit
                done[i] |= bits >> fee
    reachable = clear
    for i in range(1, n + 1):
        reachable |= done[i]
    wanted = reachable >> (zero + -(-low // unit)) if low > 0 else reachable >> zero
    if not wanted:
        return [], 0, low <= 0 <= high
    saved = (wanted & -wanted).bit_length() - 1 + max(0, -(-low // unit))
    if saved * unit > high:
        return [], 0, low <= 0 <= high
    runs: list[tuple[int, int]] = []
    left, limit = saved, n
    while left != 0 or (not runs and saved != 0):
        found = None
        for end in range(SHORTEST, limit + 1):
            if not done[end] >> (zero + left) & 1:
                continue
            for s in range(end - SHORTEST, end - longest_ok[end] - 1, -1):
                gain = prefix[end] - prefix[s] - (base + digits[s] + digits[end - 1]) // unit
                if zero + left - gain >= 0 and start[s] >> (zero + left - gain) & 1:
                    found = (s, end, gain)
                    break
            if found:
                break
        if not found:
            break
        s, end, gain = found
        runs.append((s, end))
        left, limit = left - gain, s - SHORTEST
    runs.reverse()
    exact = sum(sum(weights[s:e]) - marker_size(first_line + s, first_line + e - 1) for s, e in runs)
    return (runs, exact, True) if low <= exact <= high else ([], 0, low <= 0 <= high)


def compressed(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", budget: int = 1 << 40, keep: tuple[float, float] = (0.68, 0.72), original: bool = False) -> DataFrame:
    """(doc_id, n_lines, full_size, kept_size, dropped, within_band, output): each document, a row, without lines that neither the blocks'
    core nor the lines' core holds, so that 68 to 72 % of its size stays, markers included; as it is if that can't be. original: with
    the `text` too. Nothing is shuffled."""
    kind = docs.schema[doc].dataType
    names = ["doc_id", "n_lines", "full_size", "kept_size", "dropped", "within_band", "output", *(["text"] if original else [])]
    kinds = [to_arrow_type(kind), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.bool_(), pa.string(), pa.string()]

    def cut(i, text_: str | None, sizes: list[int] | None, core: set[int], best: set[int]) -> tuple:
        parts, sizes = (text_ or "").split("\n"), sizes if sizes is not None else [0]
        eligible = [k // LINES_A_BLOCK not in core and k + 1 not in best for k in range(len(parts))]
        full = sum(sizes)
        high = full - -(-full * round(keep[0] * 100) // 100)
        low = full - min(full * round(keep[1] * 100) // 100, budget)
        drops, saved, ok = choose_drops(sizes, eligible, low, high)
        shown, at = [], 0
        for s, e in drops:
            shown += [*parts[at:s], f"[TRUNCATED: lines {s + 1}-{e}]"]
            at = e
        return i, len(parts), full, full - saved, [k + 1 for s, e in drops for k in range(s, e)], ok, "\n".join([*shown, *parts[at:]]), text_

    def done(rows: list[tuple]) -> pa.RecordBatch:
        lines = [[] if x is None else x.split("\n") for _, x, _ in rows]
        tokens = [[words(line) for line in own] for own in lines]
        scores = scores_of_units([[(k + 1, t) for k, (line, t) in enumerate(zip(own, found, strict=True)) if line.strip(" ")] for own, found in zip(lines, tokens, strict=True)])
        out = []
        for (i, x, sizes), (ranks, _), by_line in zip(rows, ranks_of_blocks([blocks_of(t) for t in tokens]), scores, strict=True):
            core = best_of(dict(enumerate(ranks)), 12, True)
            best = best_of({k: s for k, s in by_line.items() if s > 0}, 9, False)
            out.append(cut(i, x, sizes, core, best))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(len(names))], names)

    def run(batches):
        for batch in batches:
            rows, size = [], 0
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append(row)
                size += len(row[1] or "")
                if size > 1 << 20:
                    yield done(rows)
                    rows, size = [], 0
            if rows:
                yield done(rows)

    rows = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("bare", F.transform(F.split("text", "\n"), lambda x: F.length(without_number(x))))
    made = f"doc_id {kind.simpleString()}, n_lines int, full_size long, kept_size long, dropped array<int>, within_band boolean, output string"
    return rows.mapInArrow(run, made + (", text string" if original else ""))
