"""Extractive compression of the driver's documents."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import unicode_tokens
from ..operators import extract, lexical
from .lexical_queries import UNICODE
from .registry import Tables, registry

REGISTERED, query = registry()

_B = """l AS (SELECT doc_id, unnest(p) AS text, generate_subscripts(p, 1) - 1 AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
b AS (SELECT doc_id, (i // 8)::INT AS block, min(i)::INT + 1 AS first, max(i)::INT + 1 AS last, string_agg(text, chr(10) ORDER BY i) AS text FROM l GROUP BY ALL)"""
_W = f"""{_B}, x AS (SELECT doc_id, block, {UNICODE.format('text')} AS w FROM b), c AS (SELECT doc_id, count(*) AS n, avg(len(w)) AS avgdl FROM x GROUP BY doc_id),
p AS (SELECT doc_id, block, dl, term, count(*) AS tf FROM (SELECT doc_id, block, len(w) AS dl, unnest(w) AS term FROM x) GROUP BY ALL),
s AS (SELECT *, CASE WHEN tf >= 8 THEN 1e0 ELSE (tf*tf*tf + 6e0*tf + 12) / (tf*tf*tf + 12e0*tf + 48) END AS m FROM p),
a AS (SELECT doc_id, term, count(*) AS df, var_pop(tf) AS v, ln(sum(m)) - sum(m * ln(m)) / sum(m) AS e FROM s GROUP BY doc_id, term),
i AS (SELECT a.*, n, avgdl, ln((n - df + 5e-1) / (df + 5e-1) + 1) AS idf, CASE WHEN df < 2 THEN 1 WHEN v / (v + 1) < 1e-3 THEN 1 - df / n ELSE v / (v + 1) * greatest(1 - least(e / ln(df), 1), 0) + (1 - v / (v + 1)) * (1 - df / n) END AS info FROM a JOIN c USING (doc_id)),
g AS (SELECT *, idf * (1 + idf / max(idf) OVER (PARTITION BY doc_id) * info) AS eidf FROM i),
w AS (SELECT p.doc_id, p.block, p.term, df, n, eidf, eidf * tf * 25e-1 / (tf + 15e-1 * (25e-2 + 75e-2 * dl / avgdl)) AS w FROM p JOIN g ON p.doc_id = g.doc_id AND p.term = g.term)"""


def _weights(t: Tables) -> DataFrame:
    units = lexical.tokenised(extract.blocks(t.documents), "block", "text", unicode_tokens, ("doc_id",))
    return extract.weighted_postings(units, ("doc_id",))


@query(f"WITH {_B} SELECT doc_id, block, first, last, md5(text) AS text_hash FROM b")
def block_partition(t: Tables) -> DataFrame:
    return extract.blocks(t.documents).select("doc_id", "block", "first", "last", F.md5("text").alias("text_hash"))


@query(f"""WITH {_W}, nm AS (SELECT doc_id, block, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL), k AS (SELECT * FROM (SELECT *, max(eidf) OVER (PARTITION BY doc_id) AS top FROM w) WHERE eidf >= top * 5e-3 AND df >= 2 AND df <= greatest(n // 2, 10)),
r AS (SELECT a.doc_id, a.block AS a, b.block AS b, sum(a.w * b.w) AS dot FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.term = b.term AND a.block < b.block GROUP BY ALL),
m AS (SELECT r.doc_id, a, b, dot / (x.norm * y.norm) AS sim FROM r JOIN nm x ON x.doc_id = r.doc_id AND x.block = a JOIN nm y ON y.doc_id = r.doc_id AND y.block = b)
SELECT doc_id, a, b, round(sim, 6) AS sim FROM m QUALIFY sim >= 1e-2 * max(sim) OVER (PARTITION BY doc_id)""")
def cosine_graph_edges(t: Tables) -> DataFrame:
    return extract.similarity_edges(_weights(t), ("doc_id",)).select("doc_id", "a", "b", F.round("sim", 6).alias("sim"))


@query(f"WITH {_W}, k AS (SELECT DISTINCT doc_id, term, round(eidf * sqrt(df), 9) AS weight FROM w) SELECT doc_id, term, (row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term))::INT AS rank FROM k QUALIFY rank <= 10")
def keywords_top10(t: Tables) -> DataFrame:
    return extract.keywords(_weights(t), ("doc_id",)).select("doc_id", "term", "rank")


@query("SELECT doc_id, 1e0 AS total FROM documents")
def block_ranks_sum(t: Tables) -> DataFrame:
    """Ranks of a document's blocks are a distribution."""
    units = lexical.tokenised(extract.blocks(t.documents), "block", "text", unicode_tokens, ("doc_id",))
    edges = extract.similarity_edges(extract.weighted_postings(units, ("doc_id",)), ("doc_id",))
    return extract.document_ranks(edges, units).groupBy("doc_id").agg(F.round(F.sum("rank"), 9).alias("total"))


@query(f"WITH {_B} SELECT doc_id, count(*) AS blocks, count(*) AS positions FROM b GROUP BY doc_id")
def block_coverage_order(t: Tables) -> DataFrame:
    """Every block has one place in its document's coverage order."""
    return extract.coverage(t.documents).groupBy("doc_id").agg(F.count("*").alias("blocks"), F.count_distinct("position").alias("positions"))


@query()
def compress_documents(t: Tables) -> DataFrame:
    return extract.compressed(t.documents)


@query("SELECT doc_id, len(string_split(text, chr(10)))::INT AS n_lines, true AS sizes_agree, true AS runs_long_enough, true AS band_held, true AS kept_verbatim FROM documents")
def compress_invariants(t: Tables) -> DataFrame:
    """What must hold of every compressed document, checked from the output and the original alone."""
    done = extract.compressed(t.documents, original=True)
    marker = r"^\[TRUNCATED: lines \d+-\d+\]$"
    out, lines = F.split("output", "\n"), F.split("text", "\n")
    size = F.aggregate(out, F.lit(0), lambda a, x: a + F.length(F.when(x.rlike(marker), x).otherwise(F.regexp_replace(x, r"^\s*\d+[.:]\s?", ""))))
    kept = F.filter(lines, lambda x, i: ~F.array_contains("dropped", i + 1))
    shown = F.filter(out, lambda x: ~x.rlike(marker))
    markers = F.filter(out, lambda x: x.rlike(marker))
    spans = F.transform(markers, lambda x: F.regexp_extract(x, r"-(\d+)\]", 1).cast("int") - F.regexp_extract(x, r"lines (\d+)-", 1).cast("int") + 1)
    whole = F.size("dropped") == 0
    return done.select(
        "doc_id", "n_lines", (size == F.col("kept_size")).alias("sizes_agree"), (whole | (F.forall(spans, lambda n: n >= extract.SHORTEST) & (F.aggregate(spans, F.lit(0), lambda a, n: a + n) == F.size("dropped")))).alias("runs_long_enough"),
        (whole | ((F.col("kept_size") >= F.ceil(F.col("full_size") * 68 / 100)) & (F.col("kept_size") <= F.floor(F.col("full_size") * 72 / 100)))).alias("band_held"), (shown == kept).alias("kept_verbatim"),
    )
