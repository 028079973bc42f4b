"""The symbol store, the tool registry and JSON on the driver's tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import documents, text
from ..operators import graph, lexical, store
from .graph_queries import GRAPH, RESOLVED, SYMBOLS, edges, symbols
from .registry import Tables, registry

REGISTERED, query = registry()


@query(f"WITH {SYMBOLS} SELECT id, name, file FROM s WHERE file ILIKE 'brand#1%' AND kind = 'def' AND contains(lower(name), 'e') ORDER BY name, id LIMIT 500")
def symbols_by_prefix(t: Tables) -> DataFrame:
    """As many as may be asked for; more were."""
    return store.find_symbols(symbols(t), kind="def", prefix="BRAND#1", part="E", limit=9999).select("id", "name", "file")


_TAG = "CASE p_size % 3 WHEN 0 THEN 'name.definition.' || p_brand WHEN 1 THEN 'name.reference.call' ELSE 'other.' || p_brand END"


@query(f"""SELECT p_partkey, coalesce(nullif(p_size, 1), 99)::INT AS line, CASE p_size % 3 WHEN 0 THEN 'def' WHEN 1 THEN 'ref' END AS kind, CASE p_size % 3 WHEN 0 THEN p_brand WHEN 1 THEN 'call' END AS type,
p_size % 2 <> 0 AS type_only, CASE p_size % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'private' WHEN 2 THEN 'public' END AS visibility, {_TAG} AS tag FROM part""")
def store_projections(t: Tables) -> DataFrame:
    """A line from one of two columns, lists from JSON, flags from numbers, and what tags and modifiers say."""
    p = t.part.withColumn("tag", F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("name.definition."), "p_brand")).when(F.col("p_size") % 3 == 1, "name.reference.call").otherwise(F.concat(F.lit("other."), "p_brand")))
    words = F.when(F.col("p_size") % 4 == 0, '["static", "export"]').when(F.col("p_size") % 4 == 1, '["private"]').when(F.col("p_size") % 4 == 2, '["pub", "private"]').otherwise("[]")
    kind, type_ = store.split_tag(F.col("tag"))
    start = F.when(F.col("p_size") != 1, F.col("p_size"))
    return p.select("p_partkey", F.coalesce(start, F.lit(99)).alias("line"), kind.alias("kind"), type_.alias("type"), (F.col("p_size") % 2 != 0).alias("type_only"), store.visibility(F.from_json(words, "array<string>")).alias("visibility"), "tag")


@query(f"WITH {SYMBOLS} SELECT s.file, s.name AS symbol_name, l_returnflag AS kind, count(*) AS n, min(l_linenumber) AS first FROM lineitem JOIN s ON s.id = l_partkey GROUP BY ALL")
def anchors_of_symbols(t: Tables) -> DataFrame:
    anchors = t.lineitem.select(F.col("l_partkey").alias("symbol_id"), F.col("l_returnflag").alias("kind"), F.col("l_linenumber").alias("line"))
    return store.of_symbols(anchors, symbols(t)).groupBy("file", "symbol_name", "kind").agg(F.count("*").alias("n"), F.min("line").alias("first"))


@query("SELECT DISTINCT p_brand AS file FROM part WHERE p_type = (SELECT max(p_type) FROM part)")
def module_importers(t: Tables) -> DataFrame:
    return store.importers(t.part.select(F.col("p_brand").alias("file"), F.col("p_type").alias("module")), t.part.agg(F.max("p_type")).first()[0])


@query(f"WITH {SYMBOLS} SELECT a.id AS definition, b.id AS occurrence FROM s a JOIN s b ON a.file = b.file AND a.line = b.line AND a.id < b.id")
def occurrences_of_structures(t: Tables) -> DataFrame:
    a = symbols(t).select(F.col("id").alias("definition"), "file", "line")
    return a.join(symbols(t).select(F.col("id").alias("occurrence"), "file", "line"), ["file", "line"]).where("definition < occurrence").select("definition", "occurrence")


@query(f"WITH {SYMBOLS}, q AS (SELECT DISTINCT a.name AS a, b.name AS b FROM s a, s b WHERE a.type = b.type) SELECT DISTINCT q.a || '.' || q.b AS dotted, i.id FROM q JOIN s o ON o.name = q.a JOIN s i ON i.name = q.b AND i.file = o.file AND i.line >= o.line AND i.end_line <= o.end_line AND i.id <> o.id")
def dotted_by_containment(t: Tables) -> DataFrame:
    s = symbols(t).where("name is not null").select("name", "type").distinct()
    names = s.join(s.select(F.col("name").alias("inner"), "type"), "type").select(F.concat_ws(".", "name", "inner").alias("dotted")).distinct()
    return store.contained(symbols(t), names)


@query("""SELECT * FROM (SELECT event_type AS tool, count(*) AS score FROM events GROUP BY 1) WHERE tool IN (SELECT event_type FROM events GROUP BY 1 HAVING count(*) > 190)""")
def registered_scores(t: Tables) -> DataFrame:
    """Scores of the tools that are registered."""
    scores = t.events.groupBy(F.col("event_type").alias("tool")).agg(F.count("*").alias("score"))
    known = t.events.groupBy(F.col("event_type").alias("tool")).agg(F.count("*").alias("n")).where("n > 190")
    return scores.join(known, "tool", "left_semi")


@query("SELECT user_id, event_type AS tool FROM (SELECT DISTINCT user_id FROM events), (SELECT DISTINCT event_type FROM events) EXCEPT SELECT user_id, event_type FROM events WHERE value > 100")
def inactive_tools(t: Tables) -> DataFrame:
    """Of each session, the tools that aren't active. Tools are few."""
    e = t.events
    every = e.select("user_id").distinct().crossJoin(F.broadcast(e.select(F.col("event_type").alias("tool")).distinct()))
    return every.join(e.where("value > 100").select("user_id", F.col("event_type").alias("tool")).distinct(), ["user_id", "tool"], "left_anti")


@query("""WITH f AS (SELECT n_regionkey, s_nationkey AS ns, min(s_name) AS tool FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY ns % 3 = 0 DESC, ns) AS place FROM f)
SELECT n_regionkey AS category, tool, CASE WHEN ns % 3 = 0 THEN 1e0 ELSE 8e-1 END AS score FROM o WHERE place <= 4""")
def namespace_defaults(t: Tables) -> DataFrame:
    tools = t.supplier.select(F.col("s_nationkey").alias("namespace"), F.col("s_name").alias("tool"))
    wanted = t.nation.select(F.col("n_regionkey").alias("category"), F.col("n_nationkey").alias("namespace"), (F.col("n_nationkey") % 3 == 0).alias("always"), F.col("n_nationkey").alias("position"))
    return store.first_of_namespaces(tools, wanted, 4)


@query("""SELECT root, CASE WHEN list_contains(k, 'infra:kubernetes') THEN 'infrastructure' WHEN list_contains(k, 'lang:rust') THEN 'rust_cli' WHEN list_contains(k, 'lang:python') THEN 'python_web' WHEN list_contains(k, 'manifest:package.json') THEN 'node_web' WHEN n >= 45 THEN 'generic' END AS kind
FROM (SELECT user_id AS root, count(*) AS n, list(DISTINCT CASE WHEN value > 480 THEN 'infra:kubernetes' WHEN value > 470 THEN 'lang:rust' WHEN value > 455 THEN 'lang:python' WHEN value > 430 THEN 'manifest:package.json' ELSE 'readme:x' END) AS k FROM events GROUP BY 1)""")
def project_types(t: Tables) -> DataFrame:
    v = F.col("value")
    token = F.when(v > 480, "infra:kubernetes").when(v > 470, "lang:rust").when(v > 455, "lang:python").when(v > 430, "manifest:package.json").otherwise("readme:x")
    roots = t.events.groupBy(F.col("user_id").alias("root")).agg(F.collect_set(token).alias("tokens"), F.count("*").alias("n"))
    return roots.select("root", store.project_type(F.col("tokens"), F.col("n") / 100).alias("kind"))


@query(f"WITH {GRAPH} SELECT c.file, e.container, e.name AS callee, count(*) AS calls, string_agg(c.line::VARCHAR, ',') AS lines FROM e JOIN s c ON c.id = e.container GROUP BY c.file, e.container, e.name")
def call_lines(t: Tables) -> DataFrame:
    """Calls by identity, each with the line it is made from."""
    s = symbols(t).select(F.col("id").alias("container"), "file", "line")
    return edges(t).join(s, "container").groupBy("file", "container", F.col("name").alias("callee")).agg(F.count("*").alias("calls"), F.array_join(F.collect_list(F.col("line").cast("string")), ",").alias("lines"))


@query(f"WITH {SYMBOLS} SELECT id, file, (row_number() OVER (PARTITION BY file ORDER BY line, id))::INT AS i, count(*) OVER (PARTITION BY file) AS n FROM s")
def work_counters(t: Tables) -> DataFrame:
    """The how manyeth of how many of its file each symbol is, by line, then id."""
    from pyspark.sql import Window

    whole = Window.partitionBy("file")
    return symbols(t).select("id", "file", F.row_number().over(whole.orderBy("line", "id")).alias("i"), F.count("*").over(whole).alias("n"))


@query("""WITH r AS (SELECT conv_id AS file, turn AS line, CASE WHEN role = 'user' THEN 'module' ELSE 'import' END AS type, role || turn AS name FROM conversations),
g AS (SELECT *, sum((type = 'module')::INT) OVER (PARTITION BY file ORDER BY line) AS g FROM r)
SELECT file, any_value(module) AS module, coalesce(string_agg(CASE WHEN type = 'import' THEN name END, ',' ORDER BY line), '') AS names, min(line) AS line, max(line) AS end_line
FROM (SELECT *, CASE WHEN g = 0 THEN line END AS own, first_value(name) OVER (PARTITION BY file, g, CASE WHEN g = 0 THEN line END ORDER BY line) AS module FROM g) GROUP BY file, g, own""")
def import_statements(t: Tables) -> DataFrame:
    refs = t.conversations.select(F.col("conv_id").alias("file"), F.col("turn").alias("line"), F.lit(0).alias("seq"), F.when(F.col("role") == "user", "module").otherwise("import").alias("type"), F.concat("role", F.col("turn").cast("string")).alias("name"))
    return store.import_groups(refs).select("file", "module", F.array_join("names", ",").alias("names"), "line", "end_line")


@query("""WITH d AS (SELECT source, doc_id, n_chars::DOUBLE AS c, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
m AS (SELECT source, any_value(n) AS n, avg(c) AS mean, sum(CASE WHEN i < greatest(3, n // 10) THEN c ELSE 0 END) / any_value(greatest(3, n // 10)) AS lead FROM d GROUP BY source)
SELECT d.doc_id, round(CASE WHEN d.n <= 1 THEN 1 ELSE 1 + (CASE WHEN mean > 0 THEN greatest(0, least(1, (lead / mean - 1) * 25e-1)) ELSE 0 END) * exp(-i / greatest(d.n * 1e-1, 1)) + 3e-1 * exp(-(d.n - 1 - i) / greatest(d.n * 5e-2, 1)) END, 6) AS prior FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source""")
def position_priors(t: Tables) -> DataFrame:
    rows = t.documents.select("source", "doc_id", F.col("n_chars").cast("double").alias("c"))
    return store.position_prior(rows, ("source",), "doc_id", "c").select("doc_id", F.round("prior", 6).alias("prior"))


@query(f"""WITH {GRAPH}, deg AS (SELECT s.file, s.line, count(*) AS calls FROM e JOIN s ON s.name = e.name GROUP BY ALL),
w AS (SELECT s.file, lower(s.name) AS name, 1 + floor(log2(1 + coalesce(calls, 0)))::BIGINT AS weight FROM s LEFT JOIN deg ON deg.file = s.file AND deg.line = s.line),
x AS (SELECT file, weight, unnest(regexp_extract_all(name, '[\\p{{L}}\\p{{N}}_]+')) AS term FROM w UNION ALL SELECT DISTINCT file, 3, u FROM s, (SELECT unnest(['small', 'steel']) AS u))
SELECT file, term, sum(weight)::BIGINT AS qtf FROM x GROUP BY ALL""")
def line_query_terms(t: Tables) -> DataFrame:
    s = symbols(t)
    degrees = edges(t).groupBy("name").agg(F.count("*").alias("calls")).join(s.select("name", "file", "line"), "name").select("file", "line", "calls")
    return lexical.line_query(s.select("file", "name", "line"), degrees, ("file",), scan="small steel")


@query(f"""WITH {GRAPH}, c AS (SELECT s.name AS caller, e.name AS callee, count(*) AS calls FROM e JOIN s ON s.id = e.container GROUP BY ALL),
m AS (SELECT a.name AS a, b.name AS b, count(*)::DOUBLE AS sim FROM s a JOIN s b ON a.file = b.file AND a.line = b.line AND a.name < b.name GROUP BY ALL),
u AS (SELECT a, b, sim AS w FROM m UNION ALL SELECT b, a, sim FROM m UNION ALL SELECT caller, callee, sqrt(calls) FROM c UNION ALL SELECT callee, caller, 4 * sqrt(calls) FROM c)
SELECT a, b, round(sum(w), 6) AS w FROM u WHERE a <> b GROUP BY a, b""")
def merged_call_edges(t: Tables) -> DataFrame:
    s = symbols(t)
    a, b = s.select(F.col("name").alias("a"), "file", "line"), s.select(F.col("name").alias("b"), "file", "line")
    similar = a.join(b, ["file", "line"]).where("a < b").groupBy("a", "b").agg(F.count("*").cast("double").alias("sim"))
    calls = graph.caller_counts(edges(t), s).groupBy("caller", F.col("name").alias("callee")).agg(F.sum("calls").alias("calls"))
    return store.merged_edges(similar, calls).select("a", "b", F.round("w", 6).alias("w"))


@query(f"""WITH {RESOLVED}, d AS (SELECT file, string_agg(line || ':' || name || ':' || id, ',' ORDER BY line, name, id) AS defs FROM s GROUP BY file),
c AS (SELECT file, string_agg(x || ':' || y || ':' || n, ',' ORDER BY x, y, n) AS calls FROM (SELECT a.file, a.line AS x, b.line AS y, count(*) AS n FROM r JOIN s a ON a.id = r.container JOIN s b ON b.id = r.callee WHERE a.file = b.file GROUP BY a.file, a.id, a.line, b.id, b.line) GROUP BY file),
f AS (SELECT file, string_agg(x || ':' || name || ':' || n, ',' ORDER BY x, name, n) AS refs FROM (SELECT a.file, a.line AS x, r.name, count(*) AS n FROM r JOIN s a ON a.id = r.container GROUP BY a.file, a.id, a.line, r.name) GROUP BY file)
SELECT d.file, md5(defs) AS defs, md5(coalesce(calls, '')) AS calls, md5(coalesce(refs, '')) AS refs FROM d LEFT JOIN c ON c.file = d.file LEFT JOIN f ON f.file = d.file""")
def file_facts(t: Tables) -> DataFrame:
    found = store.file_facts(symbols(t), graph.resolved(edges(t), symbols(t)))
    listed = lambda c, *n: F.md5(F.array_join(F.transform(F.coalesce(c, F.array()), lambda x: F.concat_ws(":", *(x[i].cast("string") for i in n))), ",").cast("binary"))
    return found.select("file", listed(F.col("defs"), "line", "name", "id").alias("defs"), listed(F.col("calls"), "container_line", "callee_line", "n").alias("calls"), listed(F.col("references"), "container_line", "name", "n").alias("refs"))


_TOOL = """'{"type":"object","description":"' || p_type || '","properties":{"size":{"description":"s","type":"int"},"' || p_brand || '":{"type":"' || p_name || '","items":[{"description":"i"},"x"]}}}'"""


@query(f"""SELECT p_partkey, '{{"description":"' || p_type || '","properties":{{"' || p_brand || '":{{"items":[{{"description":"i"}},"x"],"type":"' || p_name || '"}},"size":{{"description":"s","type":"int"}}}},"type":"object"}}' AS canonical,
'{{"type":"object","properties":{{"size":{{"type":"int"}},"' || p_brand || '":{{"type":"' || p_name || '","items":[{{}},"x"]}}}}}}' AS bare, p_brand || ' size' AS names, 'object|' || p_type || '|s|int|' || p_name || '|i|x' AS texts, (length({_TOOL}) // 2)::INT AS tokens, greatest(1, length(p_name) // 4)::INT AS name_tokens FROM part""")
def schema_texts(t: Tables) -> DataFrame:
    j = F.concat(F.lit('{"type":"object","description":"'), "p_type", F.lit('","properties":{"size":{"description":"s","type":"int"},"'), "p_brand", F.lit('":{"type":"'), "p_name", F.lit('","items":[{"description":"i"},"x"]}}}'))
    return t.part.withColumn("j", j).select(
        "p_partkey", documents.canonical(F.col("j")).alias("canonical"), documents.without_descriptions(F.col("j")).alias("bare"), F.array_join(documents.parameter_names(F.col("j")), " ").alias("names"),
        F.array_join(documents.string_values(F.col("j")), "|").alias("texts"), documents.token_estimate(F.col("j")).alias("tokens"), documents.token_estimate(F.col("p_name")).alias("name_tokens"),
    )


@query("""SELECT p_brand, count(*) AS tools, sha256('[' || string_agg('{"k":"' || k || '","d":"' || p_type || '","p":"' || p_size || '"}', ',' ORDER BY k) || ']') AS schema_hash
FROM (SELECT *, p_brand || '__' || p_partkey AS k FROM part) GROUP BY p_brand""")
def catalogue_hashes(t: Tables) -> DataFrame:
    tools = t.part.select("p_brand", F.concat_ws("__", "p_brand", F.col("p_partkey").cast("string")).alias("key"), F.col("p_type").alias("description"), F.col("p_size").cast("string").alias("parameters"))
    return store.catalogue_hash(tools, ("p_brand",))


@query("""SELECT doc_id, replace(replace(replace(text, chr(9), '\\t'), chr(10), '\\n'), chr(13), '\\r') AS shown, len(string_split(text, 'an')) - 1 AS times, contains(lower(text), 'token') OR contains(lower(text), 'mail') AS triggered, contains(text, 'ed') AS mentioned FROM documents""")
def text_marks(t: Tables) -> DataFrame:
    d = F.col("text")
    triggers = F.array(F.lit("Token"), F.lit("MAIL"))
    suffix = F.substring_index(F.lit("server__ed"), "__", -1)
    return t.documents.select("doc_id", documents.escaped(d).alias("shown"), text.count_of(d, "an").cast("long").alias("times"), text.mentions_any(d, triggers).alias("triggered"), F.contains(d, suffix).alias("mentioned"))


@query("""SELECT page_id, regexp_extract(url, '[^/]*$') AS base, lower(regexp_extract(regexp_extract(url, '[^/]*$'), '\\.[^.]*$')) AS ext, string_split('ns' || page_id || '__' || page_id, '__')[1] AS namespace FROM pages""")
def path_parts(t: Tables) -> DataFrame:
    u = F.col("url")
    key = F.concat(F.lit("ns"), F.col("page_id").cast("string"), F.lit("__"), F.col("page_id").cast("string"))
    return t.pages.select("page_id", text.base_name(u).alias("base"), text.extension(u).alias("ext"), text.namespace_of(key).alias("namespace"))


@query("SELECT event_id, n::INT AS attempt, n >= 2 AS locked FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'error')")
def retry_locks(t: Tables) -> DataFrame:
    return store.retry_locks(t.events.where("event_type = 'error'"), ("user_id",), ("ts", "event_id")).select("event_id", "attempt", "locked")


@query("SELECT o_orderkey AS id, o_custkey AS symbol FROM orders WHERE o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")
def restorable_versions(t: Tables) -> DataFrame:
    v = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("symbol"), F.col("o_orderstatus").alias("session"), F.col("o_orderdate").alias("created"))
    return store.restorable(v, "F").select("id", "symbol")


@query("SELECT o_orderkey, 'sym' || o_custkey AS symbol, (o_orderkey % 7)::VARCHAR || ',' || (o_orderkey % 3) AS indices, (o_orderkey % 5)::VARCHAR AS ack, o_orderpriority AS body FROM orders")
def edit_payloads(t: Tables) -> DataFrame:
    n = lambda k: (F.col("o_orderkey") % k).cast("string")
    text_ = F.concat(F.lit("sym"), F.col("o_custkey").cast("string"), F.lit(" "), n(7), F.lit(", "), n(3), F.lit(" ack:"), n(5), F.lit("\n"), "o_orderpriority", F.lit("\n\nnot a block"))
    rows = t.orders.withColumn("payload", F.regexp_replace(text_, "\n\nnot a block$", "\n"))
    return store.payload_groups(rows, "o_orderkey", "payload").select("o_orderkey", "symbol", F.array_join("indices", ",").alias("indices"), F.array_join("ack", ",").alias("ack"), "body")
