"""Event analytics and fusion on the driver's tables."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bucket, conversation_terms
from ..operators import events, fusion, lexical
from .lexical_queries import _BMX, ASCII, QUERY, _one, sql_postings, sql_query
from .registry import Tables, registry

REGISTERED, query = registry()

_BUCKET = "('0x' || sha256({})[1:8])::BIGINT % 100"
_E = f"""e AS (SELECT event_id, user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn, ts, value AS latency, 1 + event_id % 6 AS tier,
 [event_type] AS calls, CASE WHEN event_id % 4 = 0 THEN [event_type] ELSE [] END AS proxies, CASE WHEN event_type = 'error' THEN ['x'] ELSE [] END AS describes,
 ['click', CASE WHEN event_id % 3 = 0 THEN 'view' ELSE 'signup' END] AS active, (5 + event_id % 10)::INT AS active_k, greatest(15e-2, 85e-2 * exp(-25e-2 * (event_id % 8))) AS alpha,
 CASE WHEN {_BUCKET.format('user_id::VARCHAR')} < 50 THEN 'canary' ELSE 'control' END AS grp FROM events)"""


def ranking_events(t: Tables) -> DataFrame:
    e, empty = t.events, F.array().cast("array<string>")
    turn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    kind = F.array("event_type")
    return e.select(
        "event_id", F.col("user_id").alias("session"), turn.alias("turn"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("latency"), (1 + F.col("event_id") % 6).alias("tier"),
        kind.alias("calls"), F.when(F.col("event_id") % 4 == 0, kind).otherwise(empty).alias("proxies"), F.when(F.col("event_type") == "error", F.array(F.lit("x"))).otherwise(empty).alias("describes"),
        F.array(F.lit("click"), F.when(F.col("event_id") % 3 == 0, "view").otherwise("signup")).alias("active"), (5 + F.col("event_id") % 10).cast("int").alias("active_k"),
        F.greatest(F.lit(0.15), 0.85 * F.exp(-0.25 * (F.col("event_id") % 8))).alias("alpha"), F.when(bucket(F.col("user_id").cast("string")) < 50, "canary").otherwise("control").alias("group"),
    )


_M = """m AS (SELECT grp, count(*) AS events, count(DISTINCT session) AS sessions, avg((len(describes) > 0)::INT) AS d, avg((tier >= 5)::INT) AS t56, avg(active_k) AS k, avg(alpha) AS al,
 sum(len(list_intersect(calls, active)))::DOUBLE / sum(len(calls)) AS recall FROM e GROUP BY grp)"""


@query(f'WITH {_E}, {_M} SELECT grp AS "group", events, sessions, round(d, 6) AS describe_rate, round(t56, 6) AS tier56_rate, round(k, 6) AS mean_active_k, round(al, 6) AS mean_alpha FROM m')
def event_rates(t: Tables) -> DataFrame:
    m = events.group_metrics(events.well_formed(ranking_events(t)), ("group",))
    return m.select("group", "events", "sessions", *(F.round(c, 6).alias(c) for c in ("describe_rate", "tier56_rate", "mean_active_k", "mean_alpha")))


@query(f'WITH {_E}, {_M} SELECT grp AS "group", round(recall, 6) AS recall FROM m')
def event_group_recall(t: Tables) -> DataFrame:
    return events.group_metrics(ranking_events(t), ("group",)).select("group", F.round("recall", 6).alias("recall"))


def _nr(p: str) -> str:
    return f"list_sort(list(value))[least(floor({p} * count(*)), count(*) - 1)::BIGINT + 1]"


@query(f"SELECT event_type, {_nr('5e-1')} AS p50, {_nr('95e-2')} AS p95, {_nr('99e-2')} AS p99 FROM events GROUP BY event_type")
def event_percentiles(t: Tables) -> DataFrame:
    return events.nearest_rank_of(t.events, ("event_type",), "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query(f"SELECT user_id, {_nr('95e-2')} AS p95 FROM events GROUP BY user_id")
def session_latency_p95(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(events.nearest_rank(F.col("value"), 0.95).alias("p95"))


@query(f"WITH {_E} SELECT tool, round(sum(exp(-1e-1 * age)), 6) AS weight FROM (SELECT unnest(list_concat(calls, proxies)) AS tool, (epoch_us(TIMESTAMP '2024-01-28') - epoch_us(ts)) / 864e8 AS age FROM e) WHERE age BETWEEN 0 AND 7 GROUP BY tool")
def freq_prior_decay(t: Tables) -> DataFrame:
    found = events.decayed_frequency(ranking_events(t), F.lit("2024-01-28").cast("timestamp"))
    return found.select("tool", F.round("weight", 6).alias("weight"))


@query(f"SELECT user_id, ({_BUCKET.format('user_id::VARCHAR')})::INT AS bucket, {_BUCKET.format('user_id::VARCHAR')} < 25 AS canary FROM (SELECT DISTINCT user_id FROM events)")
def canary_buckets(t: Tables) -> DataFrame:
    b = bucket(F.col("user_id").cast("string"))
    return t.events.select("user_id").distinct().select("user_id", b.alias("bucket"), (b < 25).alias("canary"))


_ROLL = f"""{_E}, c AS (SELECT grp, date_trunc('minute', ts) AS minute, count(*) AS n, count(*) FILTER (WHERE len(describes) > 0) AS d, count(*) FILTER (WHERE tier >= 5) AS t, sum(latency) AS l, count(*) FILTER (WHERE tier = 1) AS r FROM e GROUP BY ALL),
roll AS (SELECT grp, minute, sum(n) OVER w AS events, sum(d) OVER w / sum(n) OVER w AS describe_rate, sum(t) OVER w / sum(n) OVER w AS tier56_rate, sum(l) OVER w / sum(n) OVER w AS mean_latency, sum(r) OVER s / 6e2 AS rescores_per_s FROM c
 WINDOW w AS (PARTITION BY grp ORDER BY minute RANGE BETWEEN INTERVAL 29 MINUTES PRECEDING AND CURRENT ROW), s AS (PARTITION BY grp ORDER BY minute RANGE BETWEEN INTERVAL 9 MINUTES PRECEDING AND CURRENT ROW))"""


@query(f'WITH {_ROLL} SELECT grp AS "group", epoch(minute)::BIGINT AS minute, events::BIGINT AS events, round(describe_rate, 6) AS describe_rate, round(tier56_rate, 6) AS tier56_rate, round(mean_latency, 7) AS mean_latency, round(rescores_per_s, 6) AS rescores_per_s FROM roll')
def rolling_30m_metrics(t: Tables) -> DataFrame:
    r = events.rolling(ranking_events(t), ("group",))
    return r.select("group", F.unix_seconds("minute").alias("minute"), "events", *(F.round(c, 6).alias(c) for c in ("describe_rate", "tier56_rate")), F.round("mean_latency", 7).alias("mean_latency"), F.round("rescores_per_s", 6).alias("rescores_per_s"))


@query(f"""WITH {_ROLL} SELECT grp AS "group", epoch(minute)::BIGINT AS minute, list_aggregate(list_filter([CASE WHEN describe_rate > 25e-2 THEN 'describe_rate' END, CASE WHEN tier56_rate > 4e-1 THEN 'tier56_rate' END, CASE WHEN mean_latency > 75 THEN 'mean_latency' END], lambda x: x IS NOT NULL), 'string_agg', ',') AS alerts
FROM roll WHERE describe_rate > 25e-2 OR tier56_rate > 4e-1 OR mean_latency > 75""")
def rolling_alerts(t: Tables) -> DataFrame:
    found = events.alerts(events.rolling(ranking_events(t), ("group",)), {"describe_rate": 0.25, "tier56_rate": 0.4, "mean_latency": 75.0})
    return found.select("group", F.unix_seconds("minute").alias("minute"), F.array_join("alerts", ",").alias("alerts"))


@query("""WITH f AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM f)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 1800000000 AS end_us, count(*) AS events FROM g GROUP BY user_id, s""")
def session_reaping(t: Tables) -> DataFrame:
    found = events.sessions(t.events, ("user_id",))
    return found.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "events")


@query(f"""WITH {_E}, {_M}, a AS (SELECT * FROM m WHERE grp = 'canary'), b AS (SELECT * FROM m WHERE grp = 'control'),
g AS (SELECT (SELECT {_nr('95e-2')} FROM events) < 50 AS latency_ok, (SELECT avg((tier >= 5)::INT) FROM e) < 5e-2 AS tier56_ok, least(a.events, b.events) >= 20 AS enough, a.recall - b.recall >= 5e-2 AS recall_ok, 1 - a.d / b.d >= 2e-1 AS describe_ok FROM a, b)
SELECT *, latency_ok AND tier56_ok AND enough AND recall_ok AND describe_ok AS cut_over FROM g""")
def cutover_gates(t: Tables) -> DataFrame:
    latency = events.nearest_rank_of(t.events.withColumn("all", F.lit(1)), ("all",), "value", {"p95": 0.95})
    return events.gates(events.group_metrics(ranking_events(t), ("group",)), latency)


_TOK = "tok AS (SELECT user_id % 10 AS root, CASE WHEN event_type IN ('click', 'view') THEN 'lang:' ELSE 'ci:' END || event_type AS token, value AS weight FROM events)"


def _tokens(t: Tables) -> DataFrame:
    return t.events.select((F.col("user_id") % 10).alias("root"), F.concat(F.when(F.col("event_type").isin("click", "view"), "lang:").otherwise("ci:"), F.col("event_type")).alias("token"), F.col("value").alias("weight"))


@query(f"WITH {_TOK} SELECT root, token, round(sum(weight), 4) AS weight FROM tok GROUP BY ALL")
def evidence_merge(t: Tables) -> DataFrame:
    return events.merged_evidence(_tokens(t), ("root",)).select("root", "token", F.round("weight", 4).alias("weight"))


@query(f"WITH {_TOK} SELECT root, least(1e0, count(DISTINCT split_part(token, ':', 1)) / 3e0) AS confidence FROM tok GROUP BY root")
def evidence_confidence(t: Tables) -> DataFrame:
    return events.confidence(_tokens(t), ("root",))


def _cap_sql(passes: int) -> str:
    steps = [f"WITH {_TOK}, c0 AS (SELECT root, token, split_part(token, ':', 1) AS f, sum(weight) AS w FROM tok GROUP BY ALL)"]
    for k in range(1, passes + 1):
        steps.append(f"c{k} AS (SELECT root, token, f, CASE WHEN sum(w) OVER (PARTITION BY root, f) > 35e-2 * sum(w) OVER (PARTITION BY root) THEN w * 35e-2 * sum(w) OVER (PARTITION BY root) / sum(w) OVER (PARTITION BY root, f) ELSE w END AS w FROM c{k - 1})")
    return ", ".join(steps) + f" SELECT root, token, round(w, 4) AS weight FROM c{passes}"


@query(_cap_sql(1))
def family_cap_pass1(t: Tables) -> DataFrame:
    return events.capped_families(events.merged_evidence(_tokens(t), ("root",)), ("root",), passes=1).select("root", "token", F.round("weight", 4).alias("weight"))


@query(_cap_sql(5))
def family_cap_all_passes(t: Tables) -> DataFrame:
    return events.capped_families(events.merged_evidence(_tokens(t), ("root",)), ("root",)).select("root", "token", F.round("weight", 4).alias("weight"))


def _rankings(t: Tables) -> tuple[DataFrame, DataFrame]:
    p = t.documents
    a = p.where(F.contains(F.col("text"), F.lit("the"))).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")))
    b = p.where(F.contains(F.col("text"), F.lit("an"))).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("n_chars", "doc_id")))
    return a.select("lang", F.col("doc_id").alias("doc"), "rank"), b.select("lang", F.col("doc_id").alias("doc"), "rank")


@query("""WITH a AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents WHERE contains(text, 'the')),
b AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS r FROM documents WHERE contains(text, 'an')),
f AS (SELECT coalesce(a.lang, b.lang) AS lang, coalesce(a.doc_id, b.doc_id) AS doc_id, 6e-1 / (10 + coalesce(a.r, (SELECT coalesce(max(r), 0) + 1 FROM a x WHERE x.lang = b.lang))) + 4e-1 / (10 + coalesce(b.r, (SELECT coalesce(max(r), 0) + 1 FROM b x WHERE x.lang = a.lang))) AS score FROM a FULL JOIN b ON a.lang = b.lang AND a.doc_id = b.doc_id)
SELECT lang, doc_id, round(score, 8) AS score, (row_number() OVER (PARTITION BY lang ORDER BY round(score, 9) DESC, doc_id))::INT AS rank FROM f""")
def rrf_fusion(t: Tables) -> DataFrame:
    a, b = _rankings(t)
    return fusion.weighted_rrf(a, b, 0.6, ("lang",)).select("lang", F.col("doc").alias("doc_id"), F.round("score", 8).alias("score"), "rank")


@query("""WITH a AS (SELECT conv_id, turn, conv_id % 10 / 10e0 AS ws, (turn % 4) / 4e0 AS cv, conv_id % 5 = 0 AS rc, contains(text, 'the') AS tm FROM conversations),
b AS (SELECT *, greatest(15e-2, 85e-2 * exp(-25e-2 * turn)) AS x FROM a), c AS (SELECT *, CASE WHEN ws < 45e-2 THEN greatest(15e-2, x - 2e-1) ELSE x END AS y FROM b),
d AS (SELECT *, CASE WHEN tm AND cv >= 7e-1 THEN 15e-2 ELSE y END AS z FROM c) SELECT conv_id, turn, round(CASE WHEN rc THEN greatest(z, 8e-1) ELSE z END, 6) AS alpha FROM d""")
def alpha_schedule(t: Tables) -> DataFrame:
    a = fusion.alpha_schedule(F.col("turn"), F.col("conv_id") % 10 / 10.0, F.col("turn") % 4 / 4.0, F.col("conv_id") % 5 == 0, F.contains(F.col("text"), F.lit("the")))
    return t.conversations.select("conv_id", "turn", F.round(a, 6).alias("alpha"))


@query("""WITH RECURSIVE o AS (SELECT p_brand, p_partkey, p_size, round(p_retailprice / 1e4, 4)::DOUBLE AS score, row_number() OVER (PARTITION BY p_brand ORDER BY round(p_retailprice / 1e4, 4)::DOUBLE DESC, p_partkey) AS rn FROM part),
g AS (SELECT p_brand, rn, p_partkey, p_size, score AS anchor, 1 AS grp FROM o WHERE rn = 1 UNION ALL SELECT o.p_brand, o.rn, o.p_partkey, o.p_size, CASE WHEN anchor - score < 5e-2 THEN anchor ELSE score END, CASE WHEN anchor - score < 5e-2 THEN grp ELSE grp + 1 END FROM g JOIN o ON o.p_brand = g.p_brand AND o.rn = g.rn + 1)
SELECT p_brand, p_partkey, grp AS "group", (row_number() OVER (PARTITION BY p_brand ORDER BY grp, p_size DESC, p_partkey))::INT AS position FROM g""")
def tie_groups(t: Tables) -> DataFrame:
    scored = t.part.select("p_brand", F.col("p_partkey").alias("key"), F.round(F.col("p_retailprice") / 1e4, 4).alias("score"), F.col("p_size").alias("specificity"))
    return fusion.tolerance_groups(scored, ("p_brand",)).select("p_brand", F.col("key").alias("p_partkey"), "group", "position")


_STOP = "['the','a','an','is','are','was','were','be','to','of','and','in','for','on','with','true','false','null','none']"


@query(f"""WITH a AS (SELECT conv_id, turn, list_filter(regexp_extract_all(regexp_replace(lower(text), '[_-]', ' ', 'g'), '[a-z0-9]+'), lambda w: NOT list_contains({_STOP}, w)) AS w FROM conversations),
u AS (SELECT conv_id, turn, list_filter(w, lambda x, i: list_position(w, x) = i) AS w FROM a),
s AS (SELECT conv_id, turn, list_concat(w, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]), flatten(list_transform(w, lambda x: CASE x WHEN 'list' THEN ['get','fetch','show','enumerate'] WHEN 'create' THEN ['add','new','make','insert'] WHEN 'search' THEN ['find','query','lookup'] WHEN 'delete' THEN ['remove','destroy','drop'] WHEN 'update' THEN ['edit','modify','change','patch'] WHEN 'run' THEN ['execute','invoke','start'] WHEN 'get' THEN ['fetch','read','retrieve'] ELSE [] END))) AS w FROM u)
SELECT conv_id, turn, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') AS terms FROM s""")
def conversation_query(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", conversation_terms(F.col("text")).alias("terms"))


@query(f"""WITH {sql_postings()}, q AS (SELECT query, term, count(*) AS qtf FROM (SELECT item_id AS query, unnest({ASCII.format('text')}) AS term FROM benchmark) GROUP BY ALL),
kn AS (SELECT query, q.term, qtf, idf * (1 + 6e-1 * (1 - h)) AS w, avgdl FROM q JOIN stat USING (term)), tt AS (SELECT query, sum(w * qtf) AS total FROM kn GROUP BY query),
sc AS (SELECT query, doc, sum(w * qtf / (1 + exp(-12e-1 * (tf - k / 2) / k))) / any_value(total) AS score FROM (SELECT *, 12e-1 * (25e-2 + 75e-2 * dl / avgdl) AS k FROM post JOIN kn USING (term)) JOIN tt USING (query) GROUP BY query, doc),
rk AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM sc),
hit AS (SELECT item_id, min(rank) AS rank FROM benchmark b JOIN documents d ON contains(d.text, b.text) JOIN rk ON query = item_id AND doc = doc_id GROUP BY item_id)
SELECT b.item_id, rank::INT AS first_rank FROM benchmark b LEFT JOIN hit USING (item_id)""")
def benchmark_known_item_recall(t: Tables) -> DataFrame:
    """For each benchmark passage, the rank of the first document that contains it, by entropy BM25 over all documents; null if none
    does. The passages are a stated set of queries, asked of every text."""
    found = lexical.entropy_bm25(lexical.tokenised(t.documents), lexical.query_terms(t.benchmark, "item_id"), k=None)
    items = t.benchmark.select(F.col("item_id").alias("query"), F.col("text").alias("passage"))
    hits = t.documents.select(F.col("doc_id").alias("doc"), "text").join(items, F.contains(F.col("text"), F.col("passage"))).select("doc", "query")
    first = found.join(hits, ["query", "doc"]).groupBy("query").agg(F.min("rank").alias("first_rank"))
    return items.join(first, "query", "left").select(F.col("query").alias("item_id"), "first_rank")


@query(f"WITH {sql_postings()}, {sql_query()}, {_BMX} SELECT doc AS doc_id, round(score, 6) AS score, (row_number() OVER (ORDER BY round(score, 9) DESC, doc))::INT AS rank, 2 AS tier FROM sc QUALIFY rank <= 10")
def fallback_tiers(t: Tables) -> DataFrame:
    """The BM25 ranking of a query, or what BMX+ gives if there is none."""
    q = lexical.query_terms(_one(t, QUERY))
    docs = lexical.tokenised(t.documents)
    return fusion.first_tier([lexical.entropy_bm25(docs.where("doc < 0"), q, k=10), lexical.bmx(docs, q, k=10)]).select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"), "rank", "tier")


@query("""WITH r AS (SELECT doc_id, text, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 20),
f AS (SELECT *, regexp_extract(text, '^([^\\n]*?[.!?])(?:\\s|$)', 1) AS one FROM r)
SELECT lang, doc_id, rank::INT AS rank, CASE WHEN rank <= 3 THEN 'full' ELSE 'summary' END AS tier,
 CASE WHEN rank <= 3 THEN text WHEN one <> '' AND length(one) <= 80 THEN one WHEN length(text) <= 80 THEN text ELSE rtrim(text[1:80]) || '…' END AS shown FROM f""")
def tiered_assembly(t: Tables) -> DataFrame:
    ranked = t.documents.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")))
    return fusion.assembled(ranked, ("lang",)).select("lang", "doc_id", "rank", "tier", "shown")
