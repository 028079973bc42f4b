"""Retrieval queries on the driver's tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import unicode_tokens
from ..operators import lexical
from .registry import Tables, registry

REGISTERED, query = registry()

QUERY = "the thand worthless of erly ention idiot anti whou the"
ASCII = "list_filter(regexp_extract_all(lower({}), '[a-z0-9_]+'), lambda x: length(x) > 1 OR x IN ('a', 'i'))"
UNICODE = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"


def _one(t: Tables, text: str = QUERY) -> DataFrame:
    return t.spark.createDataFrame([(0, text)], "query int, text string")


def sql_postings(tokens: str = ASCII, text: str = "coalesce(text, '')", table: str = "documents", doc: str = "doc_id") -> str:
    return f"""
tok AS (SELECT {doc} AS doc, {tokens.format(text)} AS tokens FROM {table}),
size AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM tok),
post AS (SELECT doc, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc, len(tokens) AS dl, unnest(tokens) AS term FROM tok) GROUP BY doc, term),
tot AS (SELECT term, count(*) AS df, sum(tf) AS ttf FROM post GROUP BY term),
ent AS (SELECT term, CASE WHEN any_value(df) > 1 THEN -sum(tf / ttf * ln(tf / ttf)) / ln(any_value(df)) ELSE 0 END AS h FROM post JOIN tot USING (term) GROUP BY term),
stat AS (SELECT term, df, ttf, h, ln((n - df + 5e-1) / (df + 5e-1) + 1) AS idf, n, avgdl FROM tot JOIN ent USING (term), size)"""


def sql_query(tokens: str = ASCII, text: str = QUERY) -> str:
    return f"q AS (SELECT 0 AS query, term, count(*) AS qtf FROM (SELECT unnest({tokens.format(chr(39) + text + chr(39))}) AS term) GROUP BY term)"


BM25 = f"""{sql_postings()}, {sql_query()},
kn AS (SELECT q.term, qtf, idf * (1 + 6e-1 * (1 - h)) AS w, avgdl FROM q JOIN stat USING (term)),
sc AS (SELECT doc, sum(w * qtf / (1 + exp(-12e-1 * (tf - k / 2) / k))) / (SELECT sum(w * qtf) FROM kn) AS score
       FROM (SELECT *, 12e-1 * (25e-2 + 75e-2 * dl / avgdl) AS k FROM post JOIN kn USING (term)) GROUP BY doc)"""


@query(f"WITH {BM25} SELECT doc AS doc_id, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, doc) AS rank FROM sc) WHERE rank <= 20")
def bm25_top_docs(t: Tables) -> DataFrame:
    found = lexical.entropy_bm25(lexical.tokenised(t.documents), lexical.query_terms(_one(t)), k=20)
    return found.select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query(f"WITH {BM25} SELECT doc AS doc_id, round(score, 6) AS score FROM sc")
def bm25_all_scores(t: Tables) -> DataFrame:
    found = lexical.entropy_bm25(lexical.tokenised(t.documents), lexical.query_terms(_one(t)), k=None)
    return found.select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"WITH {sql_postings()} SELECT term, df, ttf::BIGINT AS ttf, round(idf, 6) AS idf FROM stat WHERE df >= 3")
def bm25_term_stats(t: Tables) -> DataFrame:
    docs = lexical.tokenised(t.documents)
    stats = lexical.term_stats(lexical.postings(docs), lexical.corpus_size(docs))
    return stats.where("df >= 3").select("term", "df", "ttf", F.round("idf", 6).alias("idf"))


@query(f"WITH {sql_postings()} SELECT term, round(h, 6) AS entropy FROM stat WHERE df >= 5")
def bm25_entropy(t: Tables) -> DataFrame:
    docs = lexical.tokenised(t.documents)
    stats = lexical.term_stats(lexical.postings(docs), lexical.corpus_size(docs))
    return stats.where("df >= 5").select("term", F.round("entropy", 6).alias("entropy"))


@query(f"WITH {sql_postings()} SELECT (SELECT n FROM size) AS documents, count(*) AS terms, round((SELECT avgdl FROM size), 6) AS mean_length, round(avg(h), 6) AS mean_entropy FROM stat")
def index_statistics(t: Tables) -> DataFrame:
    docs = lexical.tokenised(t.documents)
    stats = lexical.term_stats(lexical.postings(docs), lexical.corpus_size(docs))
    return stats.agg(F.max("n").alias("documents"), F.count("*").alias("terms"), F.round(F.max("avgdl"), 6).alias("mean_length"), F.round(F.avg("entropy"), 6).alias("mean_entropy"))


_PATH = "'src ' || coalesce(source, '') || ' doc' || doc_id || ' txt '"
_BOOSTED = f"({_PATH} || {_PATH} || {_PATH} || coalesce(text, '')[1:8192])"


@query(f"WITH {BM25.replace(chr(39) * 2, chr(39) * 2).replace(ASCII.format('coalesce(text, ' + chr(39) * 2 + ')'), ASCII.format(_BOOSTED), 1)} SELECT doc AS doc_id, rank::INT AS rank FROM (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, doc) AS rank FROM sc) WHERE rank <= 100")
def bm25_file_prefilter(t: Tables) -> DataFrame:
    files = t.documents.select("doc_id", "text", F.concat(F.lit("src/"), F.coalesce("source", F.lit("")), F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))
    return lexical.prefiltered(files, lexical.query_terms(_one(t))).select(F.col("doc").alias("doc_id"), "rank")


_LINE_DOCS = "(SELECT doc_id * 100000 + i AS doc_id, x AS text FROM (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)))"


@query(f"""WITH {sql_postings(table=_LINE_DOCS)}, {BM25.split('stat AS', 1)[1].split('size)', 1)[1][2:]},
r AS (SELECT doc, row_number() OVER (ORDER BY round(score, 9) DESC, doc) AS rank, length(text) + 1 AS size FROM sc JOIN {_LINE_DOCS} ON doc_id = doc)
SELECT doc // 100000 AS doc_id, (doc % 100000)::INT AS line, rank::INT AS rank FROM (SELECT *, sum(size) OVER (ORDER BY rank) AS used FROM r) WHERE used <= 15000""")
def bm25_rerank_lines_budget(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text")).select((F.col("doc_id") * 100000 + F.col("i") + 1).alias("doc"), "text")
    found = lexical.reranked_lines(rows, lexical.query_terms(_one(t)), budget=15_000)
    return found.select(F.floor(F.col("doc") / 100000).alias("doc_id"), (F.col("doc") % 100000).cast("int").alias("line"), "rank")


_PLUS = r"""
sg AS (SELECT term, tf, CASE WHEN tf >= 8 THEN 1e0 ELSE (tf*tf*tf + 6e0*tf + 12) / (tf*tf*tf + 12e0*tf + 48) END AS m FROM post),
sm AS (SELECT term, var_pop(tf) AS v, sum(m) AS mt FROM sg GROUP BY term),
se AS (SELECT sg.term, any_value(v) AS v, -sum(m / mt * ln(m / mt)) AS e FROM sg JOIN sm USING (term) GROUP BY sg.term),
inf AS (SELECT term, df, idf, n, avgdl, CASE WHEN df < 2 THEN 1 WHEN v / (v + 1) < 1e-3 THEN 1 - df / n
        ELSE v / (v + 1) * greatest(1 - least(e / ln(df), 1), 0) + (1 - v / (v + 1)) * (1 - df / n) END AS info, idf / max(idf) OVER () AS g FROM stat JOIN se USING (term))"""


@query(f"WITH {sql_postings(UNICODE)}, {_PLUS} SELECT term, round(info, 6) AS info FROM inf WHERE df >= 4")
def term_informativeness(t: Tables) -> DataFrame:
    docs = lexical.tokenised(t.documents, tokens=unicode_tokens)
    stats = lexical.term_stats(lexical.postings(docs), lexical.corpus_size(docs))
    return stats.where("df >= 4").select("term", F.round("info", 6).alias("info"))


@query(f"WITH {sql_postings(UNICODE)}, {_PLUS}, {sql_query(UNICODE)}, "
       """ts AS (SELECT doc, idf * (1 + g * info) * tf * 25e-1 / (tf + 15e-1 * (25e-2 + 75e-2 * dl / avgdl)) * qtf AS s, g * info * qtf AS told FROM post JOIN inf USING (term) JOIN q USING (term)),
sc AS (SELECT doc, sum(s) + sum((exp(2 * s) - 1) / (exp(2 * s) + 1)) / (SELECT count(*) FROM q) * sum(told) AS score FROM ts GROUP BY doc)
SELECT doc AS doc_id, round(score / (SELECT max(score) FROM sc), 6) AS score FROM sc""")
def bmxplus_all_scores(t: Tables) -> DataFrame:
    found = lexical.bmx_plus(lexical.tokenised(t.documents, tokens=unicode_tokens), lexical.query_terms(_one(t), tokens=unicode_tokens), k=None)
    return found.select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"WITH {sql_postings(UNICODE)}, {_PLUS}, {sql_query(UNICODE)}, "
       """ts AS (SELECT doc, idf * (1 + g * info) * tf * 25e-1 / (tf + 15e-1 * (25e-2 + 75e-2 * dl / avgdl)) * qtf AS s, g * info * qtf AS told FROM post JOIN inf USING (term) JOIN q USING (term)),
sc AS (SELECT doc, sum(s) + sum((exp(2 * s) - 1) / (exp(2 * s) + 1)) / (SELECT count(*) FROM q) * sum(told) AS score FROM ts GROUP BY doc)
SELECT doc AS doc_id, (row_number() OVER (ORDER BY round(score, 9) DESC, doc))::INT AS rank FROM sc QUALIFY rank <= 10""")
def bmxplus_top_docs(t: Tables) -> DataFrame:
    found = lexical.bmx_plus(lexical.tokenised(t.documents, tokens=unicode_tokens), lexical.query_terms(_one(t), tokens=unicode_tokens), k=10)
    return found.select(F.col("doc").alias("doc_id"), "rank")


_BMX = """e AS (SELECT q.*, round(coalesce(1 - h, 0), 12) AS raw, idf, n, avgdl, df FROM q LEFT JOIN stat USING (term)),
e2 AS (SELECT *, CASE WHEN max(raw) OVER () > 0 THEN raw / max(raw) OVER () ELSE 0 END AS en FROM e),
e3 AS (SELECT *, sum(en * qtf) OVER () / sum(qtf) OVER () AS eb, sum(qtf) OVER () AS m, greatest(5e-1, least(15e-1, (SELECT avgdl FROM size) / 100)) AS al FROM e2),
j AS (SELECT doc, tf, dl, qtf, idf, en, m, al, al * (dl / avgdl + eb) AS k, n, count(*) OVER (PARTITION BY doc) / m AS sh FROM post JOIN e3 USING (term)),
sc AS (SELECT doc, sum(qtf * (idf / (1 + exp(-al * (tf - k / 2) / greatest(k, 1e-2))) + greatest(en, 1e-1) * sh / ln(1 + n))) AS score FROM j GROUP BY doc)"""


@query(f"WITH {sql_postings()}, {sql_query()}, {_BMX} SELECT doc AS doc_id, round(score, 6) AS score, (row_number() OVER (ORDER BY round(score, 9) DESC, doc))::INT AS rank FROM sc QUALIFY rank <= 30")
def bmx_top_docs(t: Tables) -> DataFrame:
    found = lexical.bmx(lexical.tokenised(t.documents), lexical.query_terms(_one(t)))
    return found.select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query(f"WITH {sql_postings()}, {sql_query()}, {_BMX} SELECT doc AS doc_id, round(score / ((SELECT sum(qtf) FROM q) * (ln(1 + ((SELECT n FROM size) - 5e-1) / 15e-1) + 1 / ln(1 + (SELECT n FROM size)))), 6) AS score FROM sc")
def bmx_normalised(t: Tables) -> DataFrame:
    found = lexical.bmx(lexical.tokenised(t.documents), lexical.query_terms(_one(t)), k=None, normalised=True)
    return found.select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


_FIELD_QUERY = "steel brand small red anodized blue"


def _field_sql(field: str, weight: str) -> str:
    inner = sql_postings(ASCII, f"coalesce({field}, '')", "part", "p_partkey")
    return f"""SELECT doc, {weight} * score AS s FROM (WITH {inner}, {sql_query(ASCII, _FIELD_QUERY)}, {_BMX} SELECT doc, score FROM sc QUALIFY row_number() OVER (ORDER BY round(score, 9) DESC, doc) <= 40)"""


@query(f"""WITH u AS ({_field_sql('p_name', '3e0')} UNION ALL {_field_sql('p_brand', '25e-1')} UNION ALL {_field_sql('p_type', '1e0')})
SELECT doc AS p_partkey, round(sum(s), 6) AS score FROM u GROUP BY doc QUALIFY row_number() OVER (ORDER BY round(sum(s), 9) DESC, doc) <= 20""")
def bmx_fielded_top(t: Tables) -> DataFrame:
    found = lexical.fielded_bmx(t.part, lexical.query_terms(_one(t, _FIELD_QUERY)), {"p_name": 3.0, "p_brand": 2.5, "p_type": 1.0}, doc="p_partkey", k=20)
    return found.select(F.col("doc").alias("p_partkey"), F.round("score", 6).alias("score"))
