"""Analytics of ranking events.

events: session, turn, ts, active (array of tools), calls, describes, proxies (arrays), tier, latency, alpha, active_k, group, ..."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REQUIRED = ("session", "turn", "ts", "active", "calls", "describes", "proxies")


def well_formed(events: DataFrame) -> DataFrame:
    """Events with all required fields."""
    kept = F.lit(True)
    for name in REQUIRED:
        kept = kept & F.col(name).isNotNull()
    return events.where(kept)


def nearest_rank(value: Column, p: float) -> Column:
    """An aggregate: the element at floor(p n) of the sorted values, the last at most. Whole values are gathered in one place, so use
    it on groups of a window or a release, or on `value_counts` beyond that."""
    every = F.sort_array(F.collect_list(value))
    return F.element_at(every, (F.least(F.floor(F.lit(p) * F.size(every)), F.size(every) - 1) + 1).cast("int"))


def nearest_rank_of(rows: DataFrame, by: tuple[str, ...], value: str, ps: dict[str, float]) -> DataFrame:
    """(by..., names...): the same for groups of any size, from counts of distinct values and their running sums."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by).orderBy(value)
    sums = counted.withColumn("upto", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(Window.partitionBy(*by)))
    at = lambda p: F.least(F.floor(F.lit(p) * F.col("n")), F.col("n") - 1)
    return sums.groupBy(*by).agg(*(F.min(F.when(F.col("upto") > at(p), F.col(value))).alias(name) for name, p in ps.items()))


def rate(condition: Column) -> Column:
    return F.coalesce(F.avg(condition.cast("int")), F.lit(0.0))


def group_metrics(events: DataFrame, by: tuple[str, ...]) -> DataFrame:
    n_calls = F.size("calls")
    return events.groupBy(*by).agg(
        F.count("*").alias("events"), F.count_distinct("session").alias("sessions"), rate(F.size("describes") > 0).alias("describe_rate"), rate(F.col("tier") >= 5).alias("tier56_rate"),
        F.avg("active_k").alias("mean_active_k"), F.avg("alpha").alias("mean_alpha"), F.sum(F.size(F.array_intersect("calls", "active"))).alias("hits"), F.sum(n_calls).alias("n_calls"),
    ).withColumn("recall", F.when(F.col("n_calls") > 0, F.col("hits") / F.col("n_calls")).otherwise(0.0))


def decayed_frequency(events: DataFrame, as_of: Column, *, days: float = 7, decay: float = 0.1) -> DataFrame:
    """(tool, weight): uses of the last days, each worth exp(-decay * its age in days)."""
    age = (F.unix_micros(as_of) - F.unix_micros("ts")) / F.lit(86_400_000_000.0)
    used = events.withColumn("age", age).where(F.col("age").between(0, days)).select("age", F.explode(F.concat("calls", "proxies")).alias("tool"))
    return used.groupBy("tool").agg(F.sum(F.exp(-decay * F.col("age"))).alias("weight"))


def rolling(events: DataFrame, by: tuple[str, ...], *, minutes: int = 30, inner: int = 10) -> DataFrame:
    """(by..., minute, events, describe_rate, tier56_rate, mean_latency, rescores_per_s): over the half hour that ends with each minute
    that has events. Events are summed by minute first; only those sums meet in a window."""
    counted = events.groupBy(*by, F.date_trunc("minute", "ts").alias("minute")).agg(
        F.count("*").alias("n"), F.count_if(F.size("describes") > 0).alias("d"), F.count_if(F.col("tier") >= 5).alias("t"), F.sum("latency").alias("l"), F.count_if(F.col("tier") == 1).alias("r")
    )
    at = F.unix_seconds("minute")
    w = Window.partitionBy(*by).orderBy(at).rangeBetween(-60 * (minutes - 1), 0)
    short = Window.partitionBy(*by).orderBy(at).rangeBetween(-60 * (inner - 1), 0)
    n = F.sum("n").over(w)
    return counted.select(*by, "minute", n.alias("events"), (F.sum("d").over(w) / n).alias("describe_rate"), (F.sum("t").over(w) / n).alias("tier56_rate"), (F.sum("l").over(w) / n).alias("mean_latency"), (F.sum("r").over(short) / F.lit(60.0 * inner)).alias("rescores_per_s"))


def alerts(metrics: DataFrame, limits: dict[str, float]) -> DataFrame:
    """The rows with `alerts`, the names of what is above its limit; rows without any go."""
    found = F.array_compact(F.array(*(F.when(F.col(k) > v, F.lit(k)) for k, v in limits.items())))
    return metrics.withColumn("alerts", found).where(F.size("alerts") > 0)


def sessions(events: DataFrame, by: tuple[str, ...], gap: str = "30 minutes") -> DataFrame:
    """(by..., start, end, events): uses of a session until it has been idle for the gap; end is when it would be reaped."""
    w = F.session_window(F.col("ts").cast("timestamp"), gap)
    return events.groupBy(*by, w.alias("w")).agg(F.count("*").alias("events")).select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def merged_evidence(tokens: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by..., token, weight): weights of a token from all roots together."""
    return tokens.groupBy(*by, "token").agg(F.sum("weight").alias("weight"))


def family(token: Column) -> Column:
    return F.substring_index(token, ":", 1)


def capped_families(tokens: DataFrame, by: tuple[str, ...], *, cap: float = 0.35, passes: int = 5) -> DataFrame:
    """Weights scaled so that no family of tokens has more than its share of the total, in up to `passes` rounds; in each, families
    are held against the total before the round."""
    rows = tokens.withColumn("__family", family(F.col("token")))
    for _ in range(passes):
        total, own = F.sum("weight").over(Window.partitionBy(*by)), F.sum("weight").over(Window.partitionBy(*by, "__family"))
        rows = rows.withColumn("weight", F.when((total > 0) & (own > cap * total), F.col("weight") * cap * total / own).otherwise(F.col("weight")))
    return rows.drop("__family")


def confidence(tokens: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return tokens.groupBy(*by).agg(F.least(F.lit(1.0), F.count_distinct(family(F.col("token"))) / 3.0).alias("confidence"))


def gates(metrics: DataFrame, latency: DataFrame) -> DataFrame:
    """One row: whether the canary group may take over from the control group. metrics: `group_metrics` by group; latency: (p95)."""
    pick = lambda name, g: F.max(F.when(F.col("group") == g, F.col(name)))
    row = metrics.agg(*(pick(m, g).alias(f"{g}_{m}") for g in ("canary", "control") for m in ("events", "recall", "describe_rate")), (F.sum(F.col("tier56_rate") * F.col("events")) / F.sum("events")).alias("tier56"))
    row = row.withColumn("p95", latency.select("p95").scalar())
    drop = F.when(F.col("control_describe_rate") > 0, 1 - F.col("canary_describe_rate") / F.col("control_describe_rate")).otherwise(0.0)
    return row.select(
        (F.col("p95") < 50).alias("latency_ok"), (F.col("tier56") < 0.05).alias("tier56_ok"), (F.least(F.coalesce("canary_events", F.lit(0)), F.coalesce("control_events", F.lit(0))) >= 20).alias("enough"),
        (F.col("canary_recall") - F.col("control_recall") >= 0.05).alias("recall_ok"), (drop >= 0.20).alias("describe_ok"),
    ).withColumn("cut_over", F.col("latency_ok") & F.col("tier56_ok") & F.col("enough") & F.col("recall_ok") & F.col("describe_ok"))
