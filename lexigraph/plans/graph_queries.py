"""Queries on the symbol graph: parts as symbols, the next line of an order as what a line refers to."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import graph
from .registry import Tables, registry

REGISTERED, query = registry()

SYMBOLS = "s AS (SELECT p_partkey AS id, p_name AS name, 'def' AS kind, p_type AS type, p_brand AS file, (p_partkey % 500)::BIGINT AS line, (p_partkey % 500 + p_size)::BIGINT AS end_line FROM part)"
EDGES = """l AS (SELECT l_orderkey AS o, l_partkey AS container, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS target FROM lineitem),
e AS (SELECT container, name FROM l JOIN s ON s.id = l.target)"""
GRAPH = f"{SYMBOLS}, {EDGES}"


def symbols(t: Tables) -> DataFrame:
    line = F.col("p_partkey") % 500
    return t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("def").alias("kind"), F.col("p_type").alias("type"), F.col("p_brand").alias("file"), line.alias("line"), (line + F.col("p_size")).alias("end_line"))


def edges(t: Tables) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = t.lineitem.select(F.col("l_partkey").alias("container"), F.lead("l_partkey").over(w).alias("id")).where("id is not null")
    return rows.join(symbols(t).select("id", "name"), "id").select("container", "name")


def name_of_most(sql: str) -> str:
    return sql.replace("$NAME", "(SELECT min(p_name) FROM part)").replace("$FILE", "(SELECT min(p_brand) FROM part WHERE p_name = (SELECT min(p_name) FROM part))")


def _name(t: Tables) -> str:
    return t.part.agg(F.min("p_name")).first()[0]


def _file(t: Tables) -> str:
    return t.part.where(F.col("p_name") == _name(t)).agg(F.min("p_brand")).first()[0]


@query(f"WITH {GRAPH} SELECT e.name, s.name AS caller, s.file, count(*) AS calls FROM e JOIN s ON s.id = e.container GROUP BY ALL")
def caller_counts(t: Tables) -> DataFrame:
    return graph.caller_counts(edges(t), symbols(t))


@query(name_of_most(f"WITH {GRAPH} SELECT s.name AS caller, s.file, count(*) AS calls FROM e JOIN s ON s.id = e.container WHERE e.name = $NAME GROUP BY ALL"))
def callers(t: Tables) -> DataFrame:
    return graph.callers(edges(t), symbols(t), _name(t))


@query(name_of_most(f"WITH {GRAPH} SELECT s.name AS caller, s.file, count(*) AS calls FROM e JOIN s ON s.id = e.container WHERE e.name = $NAME AND s.file NOT IN (SELECT file FROM s WHERE name = $NAME AND file <> $FILE) GROUP BY ALL"))
def callers_excl_competing(t: Tables) -> DataFrame:
    return graph.callers(edges(t), symbols(t), _name(t), owner=_file(t))


@query(name_of_most(f"WITH {GRAPH} SELECT e.name AS callee, count(*) AS calls FROM e JOIN s ON s.id = e.container WHERE s.name = $NAME GROUP BY ALL"))
def callees(t: Tables) -> DataFrame:
    return graph.callees(edges(t), symbols(t), _name(t))


@query(name_of_most(f"WITH {GRAPH} SELECT e.name AS callee, count(*) AS calls FROM e JOIN s ON s.id = e.container WHERE s.name = $NAME AND s.file = $FILE GROUP BY ALL"))
def callees_scoped(t: Tables) -> DataFrame:
    return graph.callees(edges(t), symbols(t), _name(t), file=_file(t))


RESOLVED = f"""{GRAPH}, r AS (SELECT e.container, c.file, e.name,
  CASE WHEN (SELECT count(*) FROM s n WHERE n.name = e.name AND n.file = c.file) = 1 THEN (SELECT min(id) FROM s n WHERE n.name = e.name AND n.file = c.file)
       WHEN (SELECT count(*) FROM s f WHERE f.name = e.name) = 1 THEN (SELECT min(id) FROM s f WHERE f.name = e.name) END AS callee
  FROM e JOIN s c ON c.id = e.container)"""


@query(f"WITH {RESOLVED} SELECT container, file, name, callee FROM r")
def edge_resolution(t: Tables) -> DataFrame:
    return graph.resolved(edges(t), symbols(t)).select("container", "file", "name", "callee")


@query(f"WITH {RESOLVED} SELECT callee IS NOT NULL AS resolved, count(*) AS edges, count(DISTINCT name) AS names FROM r GROUP BY 1")
def resolution_status_counts(t: Tables) -> DataFrame:
    return graph.resolved(edges(t), symbols(t)).groupBy(F.col("callee").isNotNull().alias("resolved")).agg(F.count("*").alias("edges"), F.count_distinct("name").alias("names"))


@query(f"WITH {RESOLVED} SELECT a.name AS caller, b.name AS callee, count(*) AS calls FROM r JOIN s a ON a.id = r.container JOIN s b ON b.id = r.callee WHERE a.file = b.file GROUP BY a.id, a.name, b.id, b.name")
def resolved_calls_within_files(t: Tables) -> DataFrame:
    r, s = graph.resolved(edges(t), symbols(t)), symbols(t)
    a = s.select(F.col("id").alias("a"), F.col("name").alias("caller"), F.col("file").alias("a_file"))
    b = s.select(F.col("id").alias("b"), F.col("name").alias("callee_name"), F.col("file").alias("b_file"))
    joined = r.join(a, F.col("container") == F.col("a")).join(b, F.col("callee") == F.col("b")).where("a_file = b_file")
    return joined.groupBy("a", "caller", "b", "callee_name").agg(F.count("*").alias("calls")).select("caller", F.col("callee_name").alias("callee"), "calls")


_PAIRS = f"{GRAPH}, p AS (SELECT DISTINCT s.type AS caller, d.type AS callee FROM l JOIN s ON s.id = l.container JOIN s d ON d.id = l.target)"


def _pairs(t: Tables) -> DataFrame:
    """Types as names."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = t.lineitem.select(F.col("l_partkey").alias("a"), F.lead("l_partkey").over(w).alias("b")).where("b is not null")
    s = t.part.select("p_partkey", "p_type")
    return rows.join(s.select(F.col("p_partkey").alias("a"), F.col("p_type").alias("caller")), "a").join(s.select(F.col("p_partkey").alias("b"), F.col("p_type").alias("callee")), "b").select("caller", "callee")


def _impact_sql(a: str, b: str) -> str:
    return f"""WITH RECURSIVE {_PAIRS}, w AS (SELECT (SELECT min(p_type) FROM part) AS name, 0 AS depth UNION SELECT p.{b}, w.depth + 1 FROM w JOIN p ON p.{a} = w.name WHERE w.depth < 3)
SELECT name, min(depth) AS depth FROM w GROUP BY name HAVING min(depth) > 0"""


@query(_impact_sql("caller", "callee"))
def impact_bfs_depth3_forward(t: Tables) -> DataFrame:
    return graph.impact(_pairs(t), t.part.agg(F.min("p_type")).first()[0])


@query(_impact_sql("callee", "caller"))
def impact_bfs_depth3_reverse(t: Tables) -> DataFrame:
    return graph.impact(_pairs(t), t.part.agg(F.min("p_type")).first()[0], reverse=True)


def _rank_sql(rounds: int) -> str:
    steps = [f"WITH {GRAPH}, w AS (SELECT s.name AS src, e.name AS dst, count(*)::DOUBLE AS w FROM e JOIN s ON s.id = e.container GROUP BY ALL), sh AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM w), n AS (SELECT DISTINCT name FROM s), r0 AS (SELECT name, 1e0 / (SELECT count(*) FROM n) AS p, 1e0 / (SELECT count(*) FROM n) AS rank FROM n)"]
    for k in range(1, rounds + 1):
        steps.append(f"r{k} AS (SELECT name, p, 15e-2 * p + 85e-2 * (coalesce((SELECT sum(rank) FROM r{k - 1} WHERE name NOT IN (SELECT src FROM sh)), 0) * p + coalesce(got, 0)) AS rank FROM r{k - 1} LEFT JOIN (SELECT dst, sum(rank * share) AS got FROM r{k - 1} JOIN sh ON src = name GROUP BY dst) ON dst = name)")
    return ", ".join(steps) + f" SELECT name, round(rank, 6) AS rank FROM r{rounds}"


@query(_rank_sql(10))
def pagerank_fixed10(t: Tables) -> DataFrame:
    links = graph.caller_counts(edges(t), symbols(t)).groupBy(F.col("caller").alias("src"), F.col("name").alias("dst")).agg(F.sum("calls").cast("double").alias("w"))
    ranks = graph.pagerank(links, symbols(t).select(F.col("name").alias("node")).distinct(), rounds=10, epsilon=None)
    return ranks.select(F.col("node").alias("name"), F.round("rank", 6).alias("rank"))


@query(f"WITH {SYMBOLS} SELECT c.id AS child, arg_min(o.id, struct_pack(span := o.end_line - o.line, line := o.line, id := o.id)) AS owner FROM s c JOIN s o ON c.file = o.file AND o.line <= c.line AND o.end_line >= c.end_line AND o.id <> c.id GROUP BY c.id")
def innermost_container(t: Tables) -> DataFrame:
    return graph.innermost(symbols(t), symbols(t))


@query(f"WITH {GRAPH} SELECT a.file, EXISTS (SELECT 1 FROM s b WHERE b.file = a.file AND b.name = e.name) AS internal, count(*) AS calls, count(DISTINCT (a.name, e.name)) AS pairs FROM e JOIN s a ON a.id = e.container GROUP BY ALL")
def block_edges_internal_external(t: Tables) -> DataFrame:
    inside, outside = graph.block_edges(edges(t), symbols(t))
    count = lambda df, flag: df.groupBy("file").agg(F.sum("calls").alias("calls"), F.count("*").alias("pairs")).withColumn("internal", F.lit(flag))
    return count(inside, True).unionByName(count(outside, False))


@query(f"WITH {SYMBOLS} SELECT file, name, id, line FROM s QUALIFY row_number() OVER (PARTITION BY file, name ORDER BY abs(line - 250), line, id) = 1")
def nearest_definition(t: Tables) -> DataFrame:
    return graph.nearest(symbols(t), 250, ("file", "name")).select("file", "name", "id", "line")


_MODES = """m AS (SELECT p_brand, split_part(p_type, ' ', 1) AS a, p_size // 10 AS b FROM part),
c AS (SELECT p_brand, a, b, count(*) AS n, min(k) AS f FROM (SELECT *, p_partkey AS k, split_part(p_type, ' ', 1) AS a, p_size // 10 AS b FROM part) GROUP BY ALL),
o AS (SELECT p_brand, a, b FROM c QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, f) = 1)"""


def _structures(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", "p_brand", F.split("p_type", " ")[0].alias("a"), F.floor(F.col("p_size") / 10).cast("int").alias("b"))


@query(f"WITH {_MODES} SELECT p_brand, a, b FROM o")
def modal_structure(t: Tables) -> DataFrame:
    return graph.modal(_structures(t), ("p_brand",), ("a", "b"), "p_partkey")


@query(f"WITH {_MODES} SELECT p_partkey, CASE WHEN split_part(p_type, ' ', 1) <> a THEN 'a' WHEN p_size // 10 <> b THEN 'b' END AS reason FROM part JOIN o USING (p_brand)")
def outlier_reason(t: Tables) -> DataFrame:
    rows = _structures(t)
    return graph.first_difference(rows, graph.modal(rows, ("p_brand",), ("a", "b"), "p_partkey"), ("p_brand",), ("a", "b")).select("p_partkey", "reason")


@query("SELECT n.n_name AS name, r.r_name AS parent, count(s.s_suppkey) AS suppliers FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey GROUP BY ALL")
def symbol_with_parent(t: Tables) -> DataFrame:
    joined = t.nation.join(t.region, F.col("r_regionkey") == F.col("n_regionkey")).join(t.supplier, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return joined.groupBy(F.col("n_name").alias("name"), F.col("r_name").alias("parent")).agg(F.count("s_suppkey").alias("suppliers"))


@query(f"WITH {SYMBOLS} SELECT id, name, file FROM s WHERE contains(lower(name), 'bolt') AND type NOT IN ('none') AND line BETWEEN 10 AND 200")
def symbol_filter(t: Tables) -> DataFrame:
    return symbols(t).where(F.lower("name").contains("bolt") & ~F.col("type").isin("none") & F.col("line").between(10, 200)).select("id", "name", "file")


@query(f"WITH {SYMBOLS} SELECT name, count(*) AS definitions, count(DISTINCT file) AS files, count(*) = 1 AS only_one FROM s GROUP BY name")
def definition_uniqueness(t: Tables) -> DataFrame:
    return symbols(t).groupBy("name").agg(F.count("*").alias("definitions"), F.count_distinct("file").alias("files"), (F.count("*") == 1).alias("only_one"))


@query(f"WITH {SYMBOLS} SELECT file, count(*) AS symbols, string_agg(type || ' ' || n, ', ' ORDER BY n DESC, type) AS summary FROM (SELECT file, type, count(*) AS n FROM s GROUP BY ALL) GROUP BY file".replace("count(*) AS symbols", "sum(n)::BIGINT AS symbols"))
def symbol_summary(t: Tables) -> DataFrame:
    counted = symbols(t).groupBy("file", "type").agg(F.count("*").alias("n"))
    parts = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "type", "n")))
    return counted.groupBy("file").agg(F.sum("n").alias("symbols"), F.array_join(F.transform(parts, lambda x: F.concat(x["type"], F.lit(" "), x["n"].cast("string"))), ", ").alias("summary"))


@query("""WITH u AS (SELECT page_id, url FROM pages), r AS (SELECT DISTINCT regexp_extract(url, '^(https?://[^/]+/[^/]+)', 1) AS root FROM pages UNION SELECT DISTINCT regexp_extract(url, '^(https?://[^/]+)', 1) FROM pages)
SELECT page_id, (SELECT arg_max(root, length(root)) FROM r WHERE root <> '' AND (url = root OR starts_with(url, root || '/'))) AS root FROM u""")
def longest_prefix_root(t: Tables) -> DataFrame:
    p = t.pages
    a = p.select(F.regexp_extract("url", "^(https?://[^/]+/[^/]+)", 1).alias("root"))
    b = p.select(F.regexp_extract("url", "^(https?://[^/]+)", 1).alias("root"))
    found = graph.longest_prefix(p.select(F.col("url").alias("path")).distinct(), a.union(b).where("root <> ''"))
    return p.join(found, F.col("url") == F.col("path")).select("page_id", "root")
