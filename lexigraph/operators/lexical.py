"""Inverted indexes and three rankings over them.

Postings are a table (doc, term, tf, dl). A ranking joins the query's terms, few and broadcast by Spark itself when small, with the
postings of those terms only: documents are tokenised, filtered to query terms and counted before anything is shuffled.

Documents without tokens count for the number of documents and the mean length. Ties go to the smaller id."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import ascii_tokens, identifier_words, rational_sigmoid, sigmoid, unicode_tokens
from .inside import grouped, scores_of_units, words
from .windows import within_budget

Tokenizer = Callable[[Column], Column]


def tokenised(docs: DataFrame, doc: str = "doc_id", text: str = "text", tokens: Tokenizer = ascii_tokens, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., doc, tokens, dl)"""
    out = docs.select(*by, F.col(doc).alias("doc"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("tokens"))
    return out.withColumn("dl", F.size("tokens"))


def corpus_size(docs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., n, avgdl) of tokenised documents."""
    return docs.groupBy(*by).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def postings(docs: DataFrame, terms: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., doc, dl, term, tf) of tokenised documents, of the given terms only if there are any."""
    out = docs.select(*by, "doc", "dl", F.explode("tokens").alias("term"))
    if terms is not None:
        out = out.join(terms.select("term").distinct(), "term", "left_semi")
    return out.groupBy(*by, "doc", "dl", "term").agg(F.count("*").alias("tf"))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1.0)


def term_stats(posted: DataFrame, sizes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., term, df, ttf, n, avgdl, idf, entropy, info). entropy: of how a term's occurrences spread over its documents, 1 for
    evenly, 0 for a term of one document. info: what the term tells, by the spread if counts vary, by rarity if not.

    The entropies come from sums of x ln x, so one aggregation does, combined before the shuffle."""
    sig = rational_sigmoid(F.col("tf").cast("double"))
    sums = posted.groupBy(*by, "term").agg(
        F.count("*").alias("df"), F.sum("tf").alias("ttf"), F.sum(F.col("tf") * F.log("tf")).alias("xlx"), F.var_pop("tf").alias("var"), F.sum(sig).alias("m"), F.sum(sig * F.log(sig)).alias("mlm")
    )
    joined = sums.join(sizes, list(by)) if by else sums.crossJoin(F.broadcast(sizes))
    even = F.log("df")
    entropy = F.when(F.col("df") > 1, (F.log("ttf") - F.col("xlx") / F.col("ttf")) / even).otherwise(0.0)
    rare = 1 - F.col("df") / F.col("n")
    alpha = F.col("var") / (F.col("var") + 1)
    spread = F.greatest(1 - F.least((F.log("m") - F.col("mlm") / F.col("m")) / even, F.lit(1.0)), F.lit(0.0))
    info = F.when(F.col("df") < 2, 1.0).when(alpha < 0.001, rare).otherwise(alpha * spread + (1 - alpha) * rare)
    return joined.select(*by, "term", "df", "ttf", "n", "avgdl", idf(F.col("n"), F.col("df")).alias("idf"), entropy.alias("entropy"), info.alias("info"))


def query_terms(queries: DataFrame, query: str = "query", text: str = "text", tokens: Tokenizer = ascii_tokens) -> DataFrame:
    """(query, term, qtf, m, unique): a row for each term of each query; m counts repeats."""
    rows = queries.select(F.col(query).alias("query"), tokens(F.col(text)).alias("tokens"))
    rows = rows.select("query", F.size("tokens").alias("m"), F.size(F.array_distinct("tokens")).alias("unique"), F.explode("tokens").alias("term"))
    return rows.groupBy("query", "m", "unique", "term").agg(F.count("*").alias("qtf"))


def top(scored: DataFrame, k: int | None, by: tuple[str, ...] = ("query",)) -> DataFrame:
    """With the rank; the k best of each. Scores that differ only by the order of addition, in the tenth decimal, are ties."""
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.round("score", 9)), "doc")))
    return out if k is None else out.where(F.col("rank") <= k)


def _matched(docs: DataFrame, queries: DataFrame, by: tuple[str, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings of query terms, their statistics, and query terms with statistics."""
    posted = postings(docs, queries, by)
    stats = term_stats(posted, corpus_size(docs, by), by)
    return posted, stats, queries.join(stats, "term", "left")


def entropy_bm25(docs: DataFrame, queries: DataFrame, *, k: int | None = 200, k1: float = 1.2, b: float = 0.75, beta: float = 0.6, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., query, doc, score, rank). A term weighs idf (1 + beta (1 - entropy)); its count saturates by a sigmoid; scores are
    shares of what the query's known terms weigh in all."""
    posted, stats, _ = _matched(docs, queries, by)
    weight = F.col("idf") * (1 + beta * (1 - F.col("entropy")))
    known = queries.join(stats.withColumn("w", weight), "term")
    total = known.groupBy(*by, "query").agg(F.sum(F.col("w") * F.col("qtf")).alias("total"))
    length = k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))
    saturated = sigmoid(k1 * (F.col("tf") - length / 2) / length)
    scored = posted.join(known, ["term", *by]).groupBy(*by, "query", "doc").agg(F.sum(F.col("w") * F.col("qtf") * saturated).alias("sum"))
    scored = scored.join(total, [*by, "query"]).select(*by, "query", "doc", (F.col("sum") / F.col("total")).alias("score")).where("score > 0")
    return top(scored, k, (*by, "query"))


def bmx(docs: DataFrame, queries: DataFrame, *, k: int | None = 30, normalised: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., query, doc, score, rank). Lengths and entropies of the query set the saturation point; each match adds what the query
    and the document share."""
    posted, stats, _ = _matched(docs, queries, by)
    grid = queries if not by else queries.crossJoin(F.broadcast(corpus_size(docs, by).select(*by)))
    # Rounded, as all queries' shares are taken of what may be an error of the last digit.
    info = F.round(1 - F.coalesce("entropy", F.lit(1.0)), 12)
    terms = grid.join(stats, ["term", *by], "left").withColumn("raw", info)
    whole = Window.partitionBy(*by, "query")
    share = F.when(F.max("raw").over(whole) > 0, F.col("raw") / F.max("raw").over(whole)).otherwise(0.0)
    terms = terms.withColumn("e", share)
    terms = terms.withColumn("mean_e", F.sum(F.col("e") * F.col("qtf")).over(whole) / F.col("m")).where("df is not null")
    alpha = F.greatest(F.lit(0.5), F.least(F.lit(1.5), F.col("avgdl") / 100))
    beta = 1 / F.log(1 + F.col("n"))
    joined = posted.join(terms, ["term", *by]).withColumn("shared", F.count("*").over(Window.partitionBy(*by, "query", "doc")) / F.col("m"))
    point = alpha * (F.col("dl") / F.col("avgdl") + F.col("mean_e"))
    saturated = sigmoid(alpha * (F.col("tf") - point / 2) / F.greatest(point, F.lit(0.01)))
    each = F.when(F.col("idf") <= 0, beta * F.col("e") * F.col("shared")).otherwise(F.col("idf") * saturated + beta * F.greatest("e", F.lit(0.1)) * F.col("shared"))
    scored = joined.groupBy(*by, "query", "doc").agg(F.sum(each * F.col("qtf")).alias("score"), F.first("m").alias("m"), F.first("n").alias("n"))
    if normalised:
        scored = scored.withColumn("score", F.col("score") / (F.col("m") * (F.log(1 + (F.col("n") - 0.5) / 1.5) + 1 / F.log(1 + F.col("n")))))
    return top(scored.select(*by, "query", "doc", "score").where("score > 0"), k, (*by, "query"))


def fielded_bmx(docs: DataFrame, queries: DataFrame, weights: dict[str, float], *, doc: str = "doc_id", k: int = 30) -> DataFrame:
    """(query, doc, score, rank): each field an index of its own, its 2k best weighted and summed."""
    fields = docs.select(F.col(doc).alias("doc_id"), F.explode(F.create_map(*[x for f in weights for x in (F.lit(f), F.coalesce(F.col(f).cast("string"), F.lit("")))])).alias("field", "text"))
    found = bmx(tokenised(fields, by=("field",)), queries, k=2 * k, by=("field",))
    weight = F.create_map(*[x for f, w in weights.items() for x in (F.lit(f), F.lit(float(w)))])
    return top(found.groupBy("query", "doc").agg(F.sum(weight[F.col("field")] * F.col("score")).alias("score")), k)


def bmx_plus(docs: DataFrame, queries: DataFrame, *, k: int | None = 10, k1: float = 1.5, b: float = 0.75, normalised: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., query, doc, score, rank). idf raised by what a term tells, the rarer the more; a soft count of matched terms adds to it.
    The largest idf is that of all terms of the corpus, so its statistics are of all."""
    every = postings(docs, None, by)
    stats = term_stats(every, corpus_size(docs, by), by)
    most = stats.groupBy(*by).agg(F.max("idf").alias("top"))
    stats = stats.join(most, list(by)) if by else stats.crossJoin(F.broadcast(most))
    gamma = F.when(F.col("top") > 0, F.col("idf") / F.col("top")).otherwise(F.col("idf"))
    terms = queries.join(stats.withColumn("g", gamma), ["term", *(c for c in by if c in queries.columns)])
    joined = every.join(terms, ["term", *by])
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    each = F.col("idf") * (1 + F.col("g") * F.col("info")) * tf * F.col("qtf")
    scored = joined.groupBy(*by, "query", "doc").agg(F.sum(each).alias("base"), (F.sum(F.tanh(each)) / F.first("unique")).alias("cover"), F.sum(F.col("g") * F.col("info") * F.col("qtf")).alias("told"))
    scored = scored.select(*by, "query", "doc", (F.col("base") + F.col("cover") * F.col("told")).alias("score"))
    if normalised:
        scored = scored.withColumn("score", F.col("score") / F.max("score").over(Window.partitionBy(*by, "query")))
    return top(scored, k, (*by, "query"))


def prefiltered(files: DataFrame, queries: DataFrame, *, path: str = "path", text: str = "text", doc: str = "doc_id", k: int = 100, head: int = 8192) -> DataFrame:
    """The k files that match a query best, by entropy BM25 over the words of their paths, three times, and their first characters."""
    words = F.regexp_replace(path, r"[/\\\\.]", " ")
    boosted = files.select(F.col(doc), F.concat_ws(" ", words, words, words, F.substring(F.coalesce(F.col(text), F.lit("")), 1, head)).alias("boosted"))
    return entropy_bm25(tokenised(boosted, doc, "boosted"), queries, k=k)


def reranked_lines(lines: DataFrame, queries: DataFrame, *, budget: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Lines (doc, text), each a document, best first, those that match nothing left out, until the next would go over the budget of
    characters (each line and one more). Of a budget of n characters no more than n lines can be left, so no more are ordered."""
    found = entropy_bm25(tokenised(lines, "doc", "text", by=by), queries, k=budget, by=by)
    sized = found.join(lines, [*by, "doc"]).withColumn("size", F.length("text") + 1)
    return within_budget(sized, (*by, "query"), ["rank"], F.col("size"), budget)


def line_query(defs: DataFrame, degrees: DataFrame, by: tuple[str, ...], *, scan: str | None = None, emphasis: int = 3) -> DataFrame:
    """(by..., term, qtf): what lines are asked for: the words of each definition (by..., name, line), whole and split, the oftener the
    more calls reach its line, 1 + log2(1 + calls) rounded down, and the words of a scan `emphasis` times. degrees: (by..., line, calls)."""
    reached = degrees.groupBy(*by, "line").agg(F.sum("calls").alias("calls"))
    whole, split = F.array_join(unicode_tokens(F.col("name")), " "), F.array_join(identifier_words(F.col("name")), " ")
    rows = defs.join(reached, [*by, "line"], "left").withColumn("weight", (1 + F.floor(F.log2(1 + F.greatest(F.coalesce("calls", F.lit(0)), F.lit(0))))).cast("long"))
    texts = rows.select(*by, "weight", F.explode(F.array_distinct(F.array(whole, split))).alias("text")).where("text <> ''")
    if scan:
        texts = texts.unionByName(defs.select(*by).distinct().withColumn("weight", F.lit(emphasis).cast("long")).withColumn("text", F.lit(scan)))
    return texts.select(*by, "weight", F.explode(unicode_tokens(F.col("text"))).alias("term")).groupBy(*by, "term").agg(F.sum("weight").alias("qtf"))


def line_scores(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line, score): each document an index of its lines, queried with all its own terms (`bmx_plus`); the best line scores 1,
    a line without words 0. The texts travel, to bring those of one id together; postings stay in the task."""
    kind = docs.schema[doc].dataType

    def run(batches):
        for held in grouped(batches):
            lines = [[line for x in texts for line in x.split("\n")] for _, texts in held]
            places = [[k + 1 for x in texts for k in range(x.count("\n") + 1)] for _, texts in held]
            units = [[] if key is None else [(k, words(x)) for k, x in zip(at, own, strict=True) if x.strip(" ")] for (key, _), at, own in zip(held, places, lines, strict=True)]
            found = scores_of_units(units)
            ids = [key for (key, _), at in zip(held, places, strict=True) for _ in at]
            scores = [own.get(k, 0.0) for own, at in zip(found, places, strict=True) for k in at]
            yield pa.RecordBatch.from_arrays([pa.array(ids, to_arrow_type(kind)), pa.array([k for at in places for k in at], pa.int32()), pa.array(scores, pa.float64())], ["doc_id", "line", "score"])

    rows = docs.select(F.col(doc).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(run, f"doc_id {kind.simpleString()}, line int, score double")


def knee(scored: DataFrame, by: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """(by..., core): how many of the best make the core: up to the sharpest fall, relative and absolute, of the falling curve; the
    square root of the number if there is no sharp one."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), *order)
    whole = Window.partitionBy(*by)
    rows = scored.select(*by, "score", F.row_number().over(w).alias("i"), F.lead("score").over(w).alias("right"), F.count("*").over(whole).alias("n"), (F.max("score").over(whole) - F.min("score").over(whole)).alias("range"))
    fall = F.col("score") - F.col("right")
    gap = F.when(F.col("right").isNotNull() & ((F.col("n") <= 3) | (F.col("i") > 1)) & (F.col("range") >= 1e-10), F.when(F.col("score") > 1e-12, fall / F.col("score")).otherwise(0.0) * fall / F.col("range"))
    best = rows.withColumn("gap", gap).groupBy(*by).agg(F.first("n").alias("n"), F.max(F.struct("gap", (-F.col("i")).alias("i"))).alias("best"))
    root = F.greatest(F.ceil(F.sqrt("n")), F.lit(1))
    core = F.when(F.col("n") < 3, F.col("n")).when(F.col("best.gap") > 0.05, -F.col("best.i")).otherwise(root)
    return best.select(*by, F.least("n", core).cast("long").alias("core"))
