"""Toxicity by weak supervision.

Terms (words, and word beginnings, for languages that build words) are counted over labelled training rows, and those that tell
toxic from clean become lexicon voters, beside fixed word lists and text patterns. A generative label model then estimates, without
trusting any one voter, how often each votes and how often it is right: a mixture of toxic and clean, fitted by EM, that starts from
what most voters say; the given labels are one voter more, as fallible as the rest. Voters are not independent given the class, so
the model has correlations in it: each voter's votes depend on the class and on one other voter, along the tree of pairs that tell
most of each other (their mutual information given the class), which is found anew as the posteriors change. A copy of a voter then
adds nothing. A logistic regression learns the posterior labels from term counts and rates, and scores every whole text.

Only the fit uses a bounded sample: about `sample` labelled training rows at most, drawn by a hash. Scores cover everything. Language,
source and id are no inputs, and rows held out (crc32 of the id, modulo 5, is 0) are never learned from.

A null or empty text gets the score that the model gives a text without terms. A null id counts as training (it has no label); a
repeated row is scored like any other. Texts of any length are scored whole. Without labelled rows of both classes the word lists
decide alone. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, materialise, tidy

WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (3, 4, 5, 6)
# Word lists from general knowledge, one voter each.
LISTS = {
    "insults": "idiot idiots idiotic moron morons moronic imbecile fool fools loser losers clown clowns scum trash stupid dumb pathetic worthless disgusting vermin filth garbage pig swine bastard jerk creep freak coward liar",
    "hate": "hate hates hated hating despise loathe kill die dead murder destroy exterminate subhuman inferior",
    "profanity": "shit shitty fuck fucking fucked fucker bitch ass asshole crap damn bloody piss dick slut whore",
    "deutsch": "idiot trottel dummkopf arschloch scheisse scheiße schwein hure wichser depp vollidiot abschaum hass",
    "francais": "idiot imbécile connard connasse salaud salope merde putain pute débile crétin ordure haine",
    "espanol": "idiota imbécil estúpido estúpida mierda puta puto cabrón gilipollas pendejo basura asqueroso odio",
}
LISTS = {k: frozenset(v.split()) for k, v in LISTS.items()}
SHOUT = re.compile(r"\b[A-Z]{4,}\b(?:\s+\b[A-Z]{4,}\b){2,}")
MASKED = re.compile(r"\b[^\W\d_]+[*#@$]{2,}[^\W\d_]+\b")
ADDRESS = re.compile(r"\b(?:you|your|u)\b(?:\s+\w+){0,4}\s+(?:" + "|".join(sorted(LISTS["insults"])) + r")\b", re.I)


def terms(text: str) -> tuple[Counter, int]:
    """Counts of words and of beginnings (with a trailing `*`), and the number of words."""
    words = Counter(WORD.findall(text.lower()))
    out: Counter = Counter()
    for w, n in words.items():
        out[w] += n
        for k in BEGINNINGS:
            if len(w) > k:
                out[w[:k] + "*"] += n
    return out, sum(words.values())


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def term_counts(labelled: DataFrame, room: int = 150_000) -> DataFrame:
    """(term, toxic, clean): in how many labelled rows each term is. Each task sums before it sends, in a table of `room` terms."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> Iterator[pa.RecordBatch]:
            keys = list(sums[0].keys() | sums[1].keys())
            for i in range(0, len(keys), 50_000):
                part = keys[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array([s[k] for k in part], pa.int64()) for s in (sums[1], sums[0]))], ["term", "toxic", "clean"])
            for s in sums:
                s.clear()

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[1 if toxic else 0].update(terms(text or "")[0].keys())
                if len(sums[0]) + len(sums[1]) > room:
                    yield from flush()
        yield from flush()

    rows = labelled.select("text", "toxic").mapInArrow(run, "term string, toxic long, clean long")
    return rows.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def telling(counts: DataFrame, n_toxic: int, n_clean: int, most: int) -> list[str]:
    """The `most` terms that tell most, by the z-score of the log odds of being in a toxic row; of beginnings of one word that are
    in the same numbers of rows only the first."""
    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5 * max(1, n_clean) / max(1, n_toxic)
    odds = F.log(a / (n_toxic - F.col("toxic") + 1.0)) - F.log(b / (n_clean - F.col("clean") + 1.0))
    z = odds / F.sqrt(1 / a + 1 / b)
    rows = counts.where("toxic + clean >= 5").select("term", "toxic", "clean", z.alias("z")).orderBy(F.desc("z"), "term").limit(4 * most).collect()
    return distinct_terms([(r.term, r.toxic, r.clean) for r in rows])[:most]


def distinct_terms(rows: list[tuple[str, int, int]]) -> list[str]:
    first: dict[tuple, str] = {}
    for term, toxic, clean in rows:
        first.setdefault((term[:3], toxic, clean), term)
    return list(first.values())


class Vocabulary:
    """Counts of the chosen terms and of the lists' words in a text."""

    def __init__(self, terms: list[str]) -> None:
        self.terms = terms
        self.memo: dict[str, tuple[int, ...]] = {}
        self.index = {t: i for i, t in enumerate(terms)}

    def __getstate__(self):
        return self.terms

    def __setstate__(self, terms):
        self.__init__(terms)

    def of(self, word: str) -> tuple[int, ...]:
        keys = [word, *(word[:k] + "*" for k in BEGINNINGS if len(word) > k)]
        found = [self.index[k] for k in keys if k in self.index] + [len(self.terms) + i for i, x in enumerate(LISTS.values()) if word in x]
        if len(self.memo) > 50_000:  # a worker keeps the model for its whole life
            self.memo.clear()
        self.memo[word] = out = tuple(found)
        return out

    def count(self, text: str) -> tuple[np.ndarray, int]:
        c = np.zeros(len(self.terms) + len(LISTS), np.float32)
        memo, of, n = self.memo, self.of, 0
        for w, k in Counter(WORD.findall(text.lower())).items():
            n += k
            for i in memo[w] if w in memo else of(w):
                c[i] += k
        return c, n


def spanning_tree(likeness: np.ndarray) -> list[int]:
    """For each node its parent in the tree of the largest likeness in all, rooted at the first node (-1); by Prim's rule."""
    m = len(likeness)
    parent, best, left = [-1] * m, likeness[0].copy() if m else np.zeros(0), set(range(1, m))
    near = np.zeros(m, np.int64)
    while left:
        k = max(left, key=lambda i: (best[i], -i))
        left.remove(k)
        parent[k] = int(near[k])
        closer = likeness[k] > best
        best[closer], near[closer] = likeness[k][closer], k
    return parent


@dataclass
class LabelModel:
    """Classes 0 and 1; votes -1 (clean), 0 (none), 1 (toxic). rates[c, k, v]: how often voter k votes v - 1 in class c. parent: the
    voter that a voter's votes depend on, given the class; given[c, k, u, v]: how often it votes v - 1 if that one votes u - 1."""

    prior: float = 0.1
    rates: np.ndarray = field(default_factory=lambda: np.zeros((2, 0, 3)))
    parent: list[int] = field(default_factory=list)
    given: np.ndarray = field(default_factory=lambda: np.zeros((2, 0, 3, 3)))
    correlation: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def fit(self, votes: np.ndarray, start: np.ndarray, rounds: int = 30, smooth: float = 1.0, shrink: float = 10.0, sure: float = 40.0, share: float = 0.2) -> np.ndarray:
        """EM from a first guess of the posteriors; returns the last. The tree is found anew every few rounds. Pairs count as if `shrink`
        rows more were independent, so few rows don't make correlations. An edge stays if it is significant (2 n times the information,
        of eight degrees of freedom, over `sure`) and tells over `share` of what one voter's votes leave open; weaker ones are rather
        what a guess of the class leaves unexplained."""
        q, (n, m) = start.astype(np.float64), votes.shape
        self.parent = [-1] * m
        shown = np.concatenate([(votes == v).astype(np.float64) for v in (-1, 0, 1)], axis=1).reshape(n, 3, m).transpose(0, 2, 1).reshape(n, 3 * m)
        for step in range(rounds):
            self.prior = float(np.clip(q.mean(), 0.005, 0.5))
            # Pairwise counts of all voters in one product for each class; the diagonal blocks are the single ones.
            pairs = np.stack([shown.T @ (shown * w[:, None]) for w in (1 - q, q)]).reshape(2, m, 3, m, 3).transpose(0, 1, 3, 2, 4)
            total = np.array([(1 - q).sum(), q.sum()])[:, None, None]
            single = np.einsum("cjjvv->cjv", pairs)
            self.rates = (single + smooth / 3) / (total + smooth)
            alone = self.rates[:, :, None, :, None] * self.rates[:, None, :, None, :]
            joint = (pairs + shrink * alone) / (total[..., None, None] + shrink)  # of two voters
            if step % 5 == 0:
                told = (joint * np.log(joint / alone)).sum((3, 4))
                self.correlation = (1 - self.prior) * told[0] + self.prior * told[1]
                entropy = np.einsum("c,ck->k", [1 - self.prior, self.prior], -(self.rates * np.log(self.rates)).sum(2))
                strong = (2 * n * self.correlation > sure) & (self.correlation > share * np.minimum(entropy[:, None], entropy))
                self.parent = [up if up >= 0 and strong[up, k] else -1 for k, up in enumerate(spanning_tree(self.correlation * strong))]
            up = [pairs[:, self.parent[k], k] for k in range(m)]
            self.given = np.stack([(x + shrink * self.rates[:, k, None]) / (x.sum(2, keepdims=True) + shrink) for k, x in enumerate(up)], axis=1)
            q = self.posterior(votes)
        return q

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        v = votes.astype(np.int64) + 1
        alone, given = np.log(self.rates[1] / self.rates[0]), np.log(self.given[1] / self.given[0])
        score = np.full(len(v), np.log(self.prior / (1 - self.prior)))
        for k, up in enumerate(self.parent):
            score += alone[k, v[:, k]] if up < 0 else given[k, v[:, up], v[:, k]]
        return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


class Voters:
    """Votes of lists, patterns and the first terms of the vocabulary on one text."""

    def __init__(self, vocabulary: list[str], lexicon: int) -> None:
        self.first, self.size = vocabulary[:lexicon], len(vocabulary)
        self.begins = np.array([t[-1] == "*" for t in self.first], bool)
        self.names = [*LISTS, "shout", "masked", "address", "many", "dense", "none", *self.first]

    def votes(self, text: str, c: np.ndarray, n: int) -> np.ndarray:
        hits, fixed = c[: len(self.first)], c[self.size :]
        total = hits[~self.begins].sum() + hits[self.begins].max(initial=0)
        patterns = [bool(p.search(text)) for p in (SHOUT, MASKED, ADDRESS)]
        sums = [total >= 3, n > 0 and total >= max(2, 0.02 * n), -1 if not total and not fixed.any() else 0]
        own = (hits >= np.where(self.begins, 3, 1)) & (hits >= 0.005 * n)
        return np.concatenate([fixed >= 2, patterns, sums, own]).astype(np.int8)


def features(c: np.ndarray, n: int) -> np.ndarray:
    """Counts and rates, damped."""
    return np.concatenate([np.log1p(c), np.minimum(c * (100.0 / max(n, 20)), 5.0)]).astype(np.float32)


def logistic(x: np.ndarray, q: np.ndarray, l2: float = 3.0, rounds: int = 250) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft labels, by accelerated gradient steps on scaled features."""
    scale = np.sqrt((x.astype(np.float64) ** 2).mean(0)) + 1e-3
    z = (x / scale).astype(np.float32)
    w, b = np.zeros(z.shape[1], np.float32), float(np.log((q.mean() + 1e-3) / (1 - q.mean() + 1e-3)))
    top = np.ones(z.shape[1], np.float32)
    for _ in range(15):  # the largest curvature
        top = z.T @ (z @ top)
        top /= np.linalg.norm(top) + 1e-12
    step = 1 / (0.25 * float(np.linalg.norm(z.T @ (z @ top))) / len(z) + l2 / len(z) + 0.25)
    v, vb, was, wasb = w.copy(), b, w, b
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ v + vb, -30, 30)))
        w, b = v - step * (z.T @ (p - q).astype(np.float32) / len(z) + l2 / len(z) * v), vb - step * float((p - q).mean())
        v, vb = w + k / (k + 3) * (w - was), b + k / (k + 3) * (b - wasb)
        was, wasb = w, b
    return (w / scale).astype(np.float64), b


@dataclass
class Model:
    vocabulary: Vocabulary
    weights: np.ndarray
    bias: float
    labels: LabelModel

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(features(*self.vocabulary.count(text)) @ self.weights + self.bias, -30, 30))))


def observed(labelled: DataFrame, vocabulary: list[str], lexicon: int) -> DataFrame:
    """(toxic, n, counts, votes): what the fit needs of a row, taken where the row lies; arrays as bytes."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters, words = Voters(vocabulary, lexicon), Vocabulary(vocabulary)
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                c, n = words.count(text or "")
                out.append((n, c.tobytes(), voters.votes(text or "", c, n).tobytes()))
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()), strict=True))], ["toxic", "n", "counts", "votes"])

    return labelled.select("text", "toxic").mapInArrow(run, "toxic int, n long, counts binary, votes binary")


def fit(rows: list, vocabulary: list[str]) -> Model:
    """The label model and the classifier on a sample of `observed` rows."""
    toxic = np.array([r.toxic for r in rows])
    labels = LabelModel()
    votes = np.column_stack([np.array([np.frombuffer(r.votes, np.int8) for r in rows]), np.where(toxic == 1, 1, -1).astype(np.int8)])
    says = votes[:, -1] + np.sign(votes[:, :-1].sum(1))  # the labels, and what most of the others say
    q = labels.fit(votes, np.where(says > 0, 0.9, 0.05))
    weights, bias = logistic(np.array([features(np.frombuffer(r.counts, np.float32), r.n) for r in rows]), q)
    return Model(Vocabulary(vocabulary), weights, bias, labels)


def fallback() -> Model:
    weights = np.zeros(2 * len(LISTS))
    weights[: len(LISTS)] = 2.0
    return Model(Vocabulary([]), weights, -3.0, LabelModel())


def train(docs: DataFrame, labels: DataFrame, *, sample: int = 30_000, fitted: int = 8_000, vocabulary: int = 400, lexicon: int = 48) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic. sample: about the most labelled training rows that the fit sees at all, to choose its
    terms; fitted: the most of these that the label model and the regression see.

    The sample is drawn from the labels, of which each id has one, by a hash at a fixed rate, so its size is bounded whatever the
    input, and its ids can be broadcast: texts are read where they lie and not shuffled."""
    gold = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    gold = gold.where(~is_held_out(F.col("doc_id"))).withColumn("draw", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)))
    drawn = lambda n, most: F.col("draw") < int(min(1.0, most / max(1, n)) * (1 << 30))
    n_gold = gold.count()
    labelled = materialise(id_and_text(docs).join(F.broadcast(gold.where(drawn(n_gold, sample))), "doc_id").select("text", "toxic", "draw"))
    n = {r.toxic: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return fallback()
    found = telling(term_counts(labelled), n[1], n[0], vocabulary)
    rows = observed(labelled.where(drawn(n_gold, 0.97 * fitted)), found, lexicon).limit(fitted).collect()
    return fit(rows, found) if {r.toxic for r in rows} == {0, 1} else fallback()


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            score = [m.score(t or "") for t in batch.column(1).to_pylist()]
            held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.bool_()), pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    return scored(docs, train(docs, labels, **options))


def keep_clean(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, all columns, that the model doesn't call toxic."""
    model = train(docs, labels, **options)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            yield batch.filter(pa.array([m.score(t or "") < 0.5 for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
