"""Documents as indexes of their own lines or blocks: what the plans of `lexical` and `extract` say of each document by itself, worked
out where the document is held, some documents at a time. No posting is shuffled; at most the texts are, once, to bring rows of one id
together. Null ids meet nothing, as in a join."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    """As `functions.text.unicode_tokens`."""
    return WORD.findall(text.lower())


def grouped(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[list[tuple]]:
    """Lists of (id, texts) of rows (id, text) that come sorted by id; a list has about `most` characters."""
    held, size = [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held and held[-1][0] == key:
                held[-1][1].append(text)
            else:
                if size > most:
                    yield held
                    held, size = [], 0
                held.append((key, [text]))
            size += len(text)
    if held:
        yield held


class Index:
    """Postings of documents, each a list of units (number, tokens), with the statistics of their terms. Units of one document, number
    and length are one. Arrays of postings: doc, no, term, tf; of what their term is to their document: df, ttf, idf, g (idf as a
    share of the document's largest), info; `part` weighs a count by the unit's length."""

    def __init__(self, docs: list[list[tuple[int, list[str]]]], k1: float = 1.5, b: float = 0.75) -> None:
        rows = [(d, k, len(t)) for d, units in enumerate(docs) for k, t in units]
        doc, no, dl = np.array(rows, np.int64).reshape(-1, 3).T
        self.n = np.bincount(doc, minlength=len(docs))
        avgdl = np.bincount(doc, dl, len(docs)) / np.maximum(self.n, 1)
        coded = pa.array([t for units in docs for _, tokens in units for t in tokens], pa.string()).dictionary_encode()
        self.terms, size = coded.dictionary, max(1, len(coded.dictionary))
        wide, long = int(no.max(initial=0)) + 1, int(dl.max(initial=0)) + 1
        units, unit = np.unique((doc * wide + no) * long + dl, return_inverse=True)
        found, tf = np.unique(np.repeat(unit, dl) * size + coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
        unit, self.term, self.tf = units[found // size], found % size, tf.astype(np.float64)
        self.doc, self.no, dl = unit // long // wide, unit // long % wide, unit % long
        pairs, q = np.unique(self.doc * size + self.term, return_inverse=True)
        of, tf, many = pairs // size, self.tf, len(pairs)
        df, ttf = np.bincount(q, minlength=many).astype(np.float64), np.bincount(q, tf, many)
        var = np.bincount(q, (tf - (ttf / df)[q]) ** 2, many) / df
        sig = np.where(tf >= 8, 1.0, (tf * tf * tf + 6.0 * tf + 12.0) / (tf * tf * tf + 12.0 * tf + 48.0))
        m, mlm = np.bincount(q, sig, many), np.bincount(q, sig * np.log(sig), many)
        n = self.n[of]
        idf = np.log((n - df + 0.5) / (df + 0.5) + 1.0)
        top = np.zeros(len(docs))
        np.maximum.at(top, of, idf)
        rare, alpha = 1 - df / n, var / (var + 1)
        spread = np.maximum(1 - np.minimum((np.log(m) - mlm / m) / np.log(np.maximum(df, 2)), 1.0), 0.0)
        info = np.where(df < 2, 1.0, np.where(alpha < 0.001, rare, alpha * spread + (1 - alpha) * rare))
        self.unique = np.bincount(of, minlength=len(docs))
        self.df, self.ttf, self.idf, self.info, self.g = df[q], ttf[q], idf[q], info[q], (idf / top[of])[q]
        self.part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl[self.doc]))


def scores_of_units(docs: list[list[tuple[int, list[str]]]]) -> list[dict[int, float]]:
    """For each document, its lines (number, tokens) by `lexical.bmx_plus`, queried with all its terms: number to score, the best 1, of
    lines that have tokens."""
    x = Index(docs)
    wide = int(x.no.max(initial=0)) + 1
    lines, at = np.unique(x.doc * wide + x.no, return_inverse=True)
    doc, told = lines // wide, x.g * x.info * x.ttf
    each = x.idf * (1 + x.g * x.info) * x.part * x.ttf
    total = lambda v: np.bincount(at, v, len(lines))
    score = total(each) + total(np.tanh(each)) / x.unique[doc] * total(told)
    top = np.zeros(len(docs))
    np.maximum.at(top, doc, score)
    out: list[dict[int, float]] = [{} for _ in docs]
    for d, line, s in zip(doc.tolist(), (lines % wide).tolist(), (score / top[doc]).tolist(), strict=True):
        out[d][line] = s
    return out


def ranks_of_blocks(docs: list[list[list[str]]], damping: float = 0.85, rounds: int = 50, epsilon: float = 1e-6) -> Iterator[tuple[list[float], dict[int, dict[int, float]]]]:
    """As `extract.similarity_edges` and `extract.document_ranks`: for each document, of the tokens of its blocks, the blocks' ranks, and
    what each block's terms weigh."""
    x = Index([list(enumerate(tokens)) for tokens in docs])
    eidf = x.idf * (1 + x.g * x.info)
    weight = eidf * x.part
    ends = np.searchsorted(x.doc, np.arange(len(docs) + 1))
    for d, tokens in enumerate(docs):
        n, own = len(tokens), slice(ends[d], ends[d + 1])
        if n < 2:
            yield [1.0] * n, {}
            continue
        no, term, e, w, df = x.no[own], x.term[own], eidf[own], weight[own], x.df[own]
        least = e.max(initial=0.0) * (0.05 if n > 5000 else 0.02 if n > 1000 else 0.005)
        most = n // 10 if n > 5000 else n // 5 if n > 1000 else max(n // 2, 10)
        kept = np.flatnonzero((e >= least) & (df >= 2) & (df <= most))
        norm, sim = np.sqrt(np.bincount(no, w * w, n)), np.zeros((n, n))
        seen, at = np.unique(term[kept], return_inverse=True)
        for i in range(0, len(seen), 1024):  # some terms at a time
            part = kept[now := (at >= i) & (at < i + 1024)]
            table = np.zeros((n, 1024))
            table[no[part], at[now] - i] = w[part]
            sim += table @ table.T
        sim /= np.maximum(np.outer(norm, norm), 1e-300)
        np.fill_diagonal(sim, 0.0)
        sim[sim < 0.01 * sim.max()] = 0.0
        total, p, rank = sim.sum(1), 1 / n, np.full(n, 1 / n)
        for _ in range(rounds):
            sent = np.divide(rank, total, out=np.zeros(n), where=total > 0)
            new = (1 - damping) * p + damping * rank[total == 0].sum() * p + damping * (sim @ sent)
            moved, rank = np.abs(new - rank).sum(), new
            if moved < epsilon:
                break
        terms: dict[int, dict[int, float]] = {}
        for k, t, v in zip(no.tolist(), term.tolist(), e.tolist(), strict=True):
            terms.setdefault(k, {})[t] = v
        yield rank.tolist(), terms


def knee_size(scores: list[float]) -> int:
    """As `lexical.knee`, of falling scores."""
    n = len(scores)
    if n < 3:
        return n
    span, best, at = scores[0] - scores[-1], 0.0, 0
    if span >= 1e-10:
        for i in range(1 if n <= 3 else 2, n):
            fall = scores[i - 1] - scores[i]
            gap = (fall / scores[i - 1] if scores[i - 1] > 1e-12 else 0.0) * fall / span
            if gap > best:
                best, at = gap, i
    return min(n, at if best > 0.05 else max(math.ceil(math.sqrt(n)), 1))


def best_of(scores: dict[int, float], digits: int, exact: bool) -> set[int]:
    """The units up to the knee of the rounded scores, the first of equals first; exact: of equal ones by scores that aren't rounded."""
    rounded = {k: float(np.round(v, digits)) for k, v in scores.items()}
    size = knee_size(sorted(rounded.values(), reverse=True))
    by = scores if exact else rounded
    return set(sorted(by, key=lambda k: (-by[k], k))[:size])
