"""Changes and history: orders as versions, suppliers as files."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import versions
from .registry import Tables, registry

REGISTERED, query = registry()

_V = "v AS (SELECT o_orderkey AS id, o_custkey AS symbol, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 'f' || o_custkey % 7 END AS file, md5(o_orderpriority) AS text_hash, o_orderstatus AS session, o_orderdate AS created FROM orders)"


def rows(t: Tables) -> DataFrame:
    file = F.when(F.col("o_orderkey") % 9 != 0, F.concat(F.lit("f"), (F.col("o_custkey") % 7).cast("string")))
    return t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("symbol"), file.alias("file"), F.md5("o_orderpriority").alias("text_hash"), F.col("o_orderstatus").alias("session"), F.col("o_orderdate").alias("created"))


@query(f"WITH {_V} SELECT id, symbol, (row_number() OVER (PARTITION BY symbol ORDER BY created DESC, id) - 1)::INT AS version FROM v")
def version_history(t: Tables) -> DataFrame:
    return versions.history(rows(t), ("symbol",), "created", "id").select("id", "symbol", "version")


@query(f"""WITH {_V}, old AS (SELECT * FROM v WHERE created < TIMESTAMP '1995-01-01'), new AS (SELECT * FROM v WHERE created >= TIMESTAMP '1995-01-01'),
f AS (SELECT * FROM new WHERE file IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, file, text_hash, session ORDER BY created, id) = 1)
SELECT id FROM old UNION ALL SELECT id FROM f WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.symbol = f.symbol AND o.file = f.file AND o.text_hash = f.text_hash AND o.session = f.session) UNION ALL SELECT id FROM new WHERE file IS NULL""")
def version_dedup(t: Tables) -> DataFrame:
    v, at = rows(t), F.lit("1995-01-01").cast("timestamp_ntz")
    old, new = v.where(F.col("created") < at), v.where(F.col("created") >= at)
    return versions.insert_or_ignore(old, new, ("symbol", "file", "text_hash", "session"), [F.col("created"), F.col("id")]).select("id")


@query(f"WITH {_V} SELECT id FROM v WHERE created >= TIMESTAMP '1998-01-01' - INTERVAL 2000 HOURS")
def ttl_prune(t: Tables) -> DataFrame:
    return versions.pruned(rows(t), "created", F.lit("1998-01-01").cast("timestamp_ntz"), "2000 hours").select("id")


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN md5(s_name || '!') ELSE md5(s_name) END AS hash FROM supplier UNION ALL SELECT s_suppkey + 1000000, md5(s_name || '!') FROM supplier WHERE s_suppkey % 50 = 0")
def upsert_files(t: Tables) -> DataFrame:
    s = t.supplier
    old = s.select(F.col("s_suppkey").alias("id"), F.md5("s_name").alias("hash"))
    new = s.select(F.col("s_suppkey").alias("id"), F.md5(F.concat("s_name", F.lit("!"))).alias("hash"))
    return versions.replaced(old, new.where("id % 3 = 0").unionByName(new.where("id % 50 = 0").withColumn("id", F.col("id") + 1_000_000)), ("id",))


@query("SELECT s_suppkey AS file, count(*) AS imports FROM supplier JOIN lineitem ON l_suppkey = s_suppkey WHERE s_suppkey % 3 <> 0 GROUP BY s_suppkey")
def upsert_cascade_children(t: Tables) -> DataFrame:
    parent = t.supplier.select(F.col("s_suppkey").alias("id"), F.md5("s_name").alias("hash"))
    imports = t.lineitem.select(F.col("l_suppkey").alias("file"), "l_orderkey").join(parent.select(F.col("id").alias("file")), "file", "left_semi")
    _, children = versions.upsert_with_cascade(parent, parent.where("id % 3 = 0"), "id", {"imports": (imports, "file")})
    return children["imports"].groupBy("file").agg(F.count("*").alias("imports"))


@query("SELECT l_partkey AS container, CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE l_suppkey END AS callee, count(*) AS n FROM lineitem GROUP BY ALL")
def delete_set_null(t: Tables) -> DataFrame:
    e = t.lineitem.select(F.col("l_partkey").alias("container"), F.col("l_suppkey").alias("callee"))
    gone = t.supplier.where("s_suppkey % 4 = 0")
    every = e.select(F.col("callee").alias("s_suppkey")).where("s_suppkey % 4 = 0").unionByName(gone.select("s_suppkey"))
    return versions.nulled(e, every, "callee", "s_suppkey").groupBy("container", "callee").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS c_mktsegment, c_nationkey FROM customer")
def update_by_id(t: Tables) -> DataFrame:
    c = t.customer.select("c_custkey", "c_mktsegment", "c_nationkey")
    return versions.updated(c, c.where("c_custkey % 2 = 0").select("c_custkey", F.lit("CHANGED").alias("c_mktsegment"), F.lit(None).cast("int").alias("c_nationkey")), "c_custkey")


@query("WITH n AS (SELECT o_custkey AS id, count(*) AS attempts FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT c_custkey AS id, coalesce(attempts, 0) AS attempts FROM customer LEFT JOIN n ON n.id = c_custkey WHERE coalesce(attempts, 0) < 2")
def stash_attempts(t: Tables) -> DataFrame:
    return versions.stash_attempts(t.customer.select(F.col("c_custkey").alias("id")), t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")))


@query("SELECT s_suppkey AS path, md5(CASE WHEN s_suppkey % 4 = 1 THEN s_name || '?' ELSE s_name END) AS hash FROM supplier WHERE s_suppkey % 4 = 1 OR s_suppkey % 10 = 3")
def changed_files(t: Tables) -> DataFrame:
    s = t.supplier
    indexed = s.where("s_suppkey % 10 <> 3").select(F.col("s_suppkey").alias("path"), F.md5("s_name").alias("hash"))
    now = s.select(F.col("s_suppkey").alias("path"), F.md5(F.when(F.col("s_suppkey") % 4 == 1, F.concat("s_name", F.lit("?"))).otherwise(F.col("s_name"))).alias("hash"))
    return versions.changed(indexed, now)


@query("SELECT c_custkey AS path FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def stale_paths(t: Tables) -> DataFrame:
    return versions.stale(t.customer.select(F.col("c_custkey").alias("path")), t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("path")))
