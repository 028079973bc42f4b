"""Streams over the driver's events, run on what is there; and edits."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import edits
from ..streaming import metrics, turns
from .event_queries import _E, ranking_events
from .registry import Tables, registry

REGISTERED, query = registry()


def _stream(t: Tables) -> DataFrame:
    schema = t.events.schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet" if not _is_folder(t) else "*.parquet").parquet(f"{t.folder}/events.parquet" if _is_folder(t) else t.folder)


def _is_folder(t: Tables) -> bool:
    path = t.spark._jvm.org.apache.hadoop.fs.Path(f"{t.folder}/events.parquet")
    return path.getFileSystem(t.spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()


@query("""WITH f AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM f)
SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS events FROM g GROUP BY user_id, s""")
def stream_sessions(t: Tables) -> DataFrame:
    found = metrics.run_once(metrics.sessions(_stream(t), ("user_id",)), mode="complete")
    return found.select("user_id", F.unix_micros("start").alias("start_us"), "events")


@query("""WITH e AS (SELECT *, floor(epoch(ts))::BIGINT AS s FROM events), w AS (SELECT event_type, value, unnest(generate_series(s // 600 * 600 - 1200, s // 600 * 600, 600)) AS start FROM e)
SELECT event_type, start, count(*) AS events, round(sum(value), 2) AS total FROM w GROUP BY ALL""")
def stream_sliding_totals(t: Tables) -> DataFrame:
    timed = _stream(t).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "10 minutes")
    rolled = timed.groupBy(F.window("at", "30 minutes", "10 minutes").alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("sum"))
    found = metrics.run_once(rolled.select("event_type", F.col("w.start").alias("start"), "events", "sum"), mode="complete")
    return found.select("event_type", F.unix_seconds("start").alias("start"), "events", F.round("sum", 2).alias("total"))


def turn_events(e: DataFrame) -> DataFrame:
    tools = F.array(*map(F.lit, ("click", "view", "signup", "purchase", "error", "a", "b", "c")))
    return e.select("session", "turn", "calls", "proxies", F.sort_array(F.transform(tools, lambda x: F.concat(F.md5(F.concat(x, (F.col("turn") % 5).cast("string"))), x))).alias("keys"), F.lit(2).alias("k")).select("session", "turn", "calls", "proxies", F.transform("keys", lambda x: F.substring(x, F.lit(33), F.lit(99))).alias("ranked"), "k")


@query(f"WITH {_E} SELECT session, count(*) AS turns FROM e GROUP BY session")
def turn_machine_turns(t: Tables) -> DataFrame:
    """Every turn of every session gives one step."""
    return turns.turns_batch(turn_events(ranking_events(t))).groupBy("session").agg(F.count("*").alias("turns"))


@query()
def turn_machine(t: Tables) -> DataFrame:
    return turns.turns_batch(turn_events(ranking_events(t)))


@query("SELECT doc_id, regexp_replace(text, '^[^\\n]*', 'NEW') AS text, 0 AS n_errors FROM documents")
def edit_first_line(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "text", F.array(F.substring_index("text", "\n", 1)).alias("olds"), F.array(F.lit("NEW")).alias("news"))
    return edits.edited(rows).select("doc_id", "text", F.size("errors").alias("n_errors"))
