"""The symbol store's joins and the graph of references.

symbols: id, name, kind (def or ref), type, file, line, end_line; edges: container (a symbol's id), name (what it refers to)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


def defs(symbols: DataFrame) -> DataFrame:
    return symbols.where("kind = 'def'")


def caller_counts(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(name, caller, file, calls): who refers to a name, and how often."""
    s = symbols.select(F.col("id").alias("container"), F.col("name").alias("caller"), "file")
    return edges.join(s, "container").groupBy("name", "caller", "file").agg(F.count("*").alias("calls"))


def callers(edges: DataFrame, symbols: DataFrame, name: str, *, owner: str | None = None) -> DataFrame:
    """(caller, file, calls) of one name. owner: the file whose definition is meant; callers in files with a definition of the same
    name of their own are then left out."""
    found = edges.where(F.col("name") == name)
    callers_of = symbols
    if owner is not None:
        rivals = defs(symbols).where((F.col("name") == name) & (F.col("file") != owner)).select("file").distinct()
        callers_of = symbols.join(rivals, "file", "left_anti")
    return caller_counts(found, callers_of).drop("name")


def callees(edges: DataFrame, symbols: DataFrame, name: str, *, file: str | None = None) -> DataFrame:
    """(callee, calls) of what definitions of a name refer to, in one file or all."""
    s = symbols.where(F.col("name") == name)
    s = s if file is None else s.where(F.col("file") == file)
    return edges.join(s.select(F.col("id").alias("container")), "container").groupBy(F.col("name").alias("callee")).agg(F.count("*").alias("calls"))


def resolved(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """The edges with `callee`: the only definition of the name in the container's file, else the only one anywhere, else null.

    Definitions are counted by name and file, and by name, before they meet the edges, so a common name adds no rows."""
    d = defs(symbols)
    near = d.groupBy("name", "file").agg(F.count("*").alias("n_near"), F.min("id").alias("near"))
    far = d.groupBy("name").agg(F.count("*").alias("n_far"), F.min("id").alias("far"))
    files = symbols.select(F.col("id").alias("container"), "file")
    joined = edges.join(files, "container").join(near, ["name", "file"], "left").join(far, "name", "left")
    return joined.withColumn("callee", F.when(F.col("n_near") == 1, F.col("near")).when(F.col("n_far") == 1, F.col("far"))).drop("n_near", "near", "n_far", "far")


def ancestors(symbols: DataFrame, depth: int = 8) -> DataFrame:
    """(id, path): names of a symbol's parents, the nearest first; parents that lead back end after `depth`."""
    now = symbols.select("id", F.col("parent").alias("up"), F.array().cast("array<string>").alias("path"))
    parents = symbols.select(F.col("id").alias("p"), F.col("name").alias("p_name"), F.col("parent").alias("p_up"))
    for _ in range(depth):
        if now.where("up is not null").isEmpty():
            break
        now = written(now.join(parents, F.col("up") == F.col("p"), "left").select("id", F.col("p_up").alias("up"), F.when(F.col("p").isNull(), F.col("path")).otherwise(F.concat("path", F.array("p_name"))).alias("path")))
    return now.select("id", "path")


def resolved_qualified(edges: DataFrame, symbols: DataFrame, depth: int = 8) -> DataFrame:
    """As `resolved` for names `A.B.m`: the only definition of m whose parents are B, A, ... in this order."""
    d = defs(symbols).join(ancestors(symbols, depth), "id").select(F.col("id").alias("found"), F.col("name").alias("last"), "path")
    parts = F.filter(F.split("name", r"\."), lambda x: x != "")
    q = edges.where(F.instr("name", ".") > 0).withColumn("parts", parts).withColumn("last", F.element_at("parts", -1)).withColumn("above", F.slice(F.reverse("parts"), 2, 1000))
    hit = q.join(d, "last").where(F.slice("path", F.lit(1), F.greatest(F.size("above"), F.lit(1))) == F.col("above"))
    only = hit.groupBy("container", "name").agg(F.count_distinct("found").alias("n"), F.min("found").alias("callee")).where("n = 1").drop("n")
    return edges.where(F.instr("name", ".") > 0).join(only, ["container", "name"], "left")


def impact(pairs: DataFrame, start: str, *, depth: int = 3, reverse: bool = False) -> DataFrame:
    """(name, depth): names reached from `start` along (caller, callee) pairs, at their least depth, up to 5. Each level is a join of
    the whole frontier, less what has been seen."""
    a, b = ("callee", "caller") if reverse else ("caller", "callee")
    steps = written(pairs.select(F.col(a).alias("at"), F.col(b).alias("name")).where("name is not null").distinct())
    seen = steps.sparkSession.createDataFrame([(start, 0)], "name string, depth int")
    frontier = seen
    for level in range(1, min(max(depth, 1), 5) + 1):
        new = frontier.select(F.col("name").alias("at")).join(steps, "at").select("name").distinct().join(seen, "name", "left_anti")
        frontier = new.withColumn("depth", F.lit(level))
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def pagerank(links: DataFrame, nodes: DataFrame, *, damping: float = 0.85, rounds: int = 50, epsilon: float | None = 1e-6, every: int = 5) -> DataFrame:
    """(node, rank). links: src, dst, w; nodes: node, and optionally p, where the walk starts anew and where rank without a way on
    goes. With an epsilon the walk ends when ranks move less than that in all, looked at every few rounds, when the table is also
    written; without one it takes all rounds."""
    p = F.col("p") if "p" in nodes.columns else F.lit(1.0)
    nodes = nodes.select("node", p.alias("p"))
    nodes = written(nodes.withColumn("p", F.col("p") / nodes.select(F.sum("p")).scalar()))
    out = Window.partitionBy("src")
    links = written(links.where("w > 0").groupBy("src", "dst").agg(F.sum("w").alias("w")).withColumn("share", F.col("w") / F.sum("w").over(out)).select("src", "dst", "share"))
    base = written(nodes.join(links.select(F.col("src").alias("node")).distinct().withColumn("on", F.lit(True)), "node", "left"))
    ranks = base.select("node", "p", "on", F.col("p").alias("rank"), F.col("p").alias("was"))
    for k in range(1, rounds + 1):
        sent = ranks.join(links, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("to")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        lost = F.coalesce(ranks.where("on is null").select(F.sum("rank")).scalar(), F.lit(0.0))
        new = (1 - damping) * F.col("p") + damping * (lost * F.col("p") + F.coalesce("got", F.lit(0.0)))
        ranks = ranks.join(sent, F.col("node") == F.col("to"), "left").select("node", "p", "on", new.alias("new"), F.col("rank").alias("was")).withColumnRenamed("new", "rank")
        if k % every == 0 or k == rounds:
            ranks = written(ranks)
            if epsilon is not None and (ranks.select(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0] or 0.0) < epsilon:
                break
    return ranks.select("node", "rank")


def innermost(children: DataFrame, owners: DataFrame) -> DataFrame:
    """(child, owner): of the owners (id, file, line, end_line) that hold a child's lines in the same file, the shortest, then first;
    a symbol isn't its own. Spans that are equal are asked for once, with the two smallest ids of their owners; each file's spans are
    then swept by their first lines, in one task."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    span = ["file", "line", "end_line"]
    place = Window.partitionBy(*span).orderBy("id")
    held = owners.select("id", *span).where("id is not null").dropna(subset=span).distinct()
    held = held.withColumn("k", F.row_number().over(place)).where("k <= 2").select(*span, F.col("id").cast("long"), F.lit(0).alias("asks"))
    asked = children.select(*span).dropna().distinct().select(*span, F.lit(None).cast("long").alias("id"), F.lit(1).alias("asks"))
    kind = children.schema["file"].dataType.simpleString()

    def answers(rows: list[tuple]) -> list[tuple]:
        """Spans with their best owner and the best of another id, by sums over a tree of last lines (largest first)."""
        ends = {e: i + 1 for i, e in enumerate(sorted({r[2] for r in rows}, reverse=True))}
        tree: list[tuple | None] = [None] * (len(ends) + 1)
        out = []

        def better(a: tuple | None, new: tuple) -> tuple:
            """Two best of different ids."""
            if a is None:
                return new, None
            first, second = a
            if new == first:
                return a
            if new < first:
                return new, first if first[2] != new[2] else second
            return (first, new) if new[2] != first[2] and (second is None or new < second) else a

        for _, line, end, own, asks in sorted(rows, key=lambda r: (r[1], r[4])):
            i = ends[end]
            if asks:
                found = None
                while i:
                    for x in tree[i] or ():
                        if x is not None:
                            found = better(found, x)
                    i &= i - 1
                out.append((line, end, found))
                continue
            while i < len(tree):
                now = better(tree[i], (end - line, line, own))
                if now is not tree[i]:
                    tree[i] = now
                i += i & -i
        return out

    def run(batches):
        file, rows = None, []

        def close() -> pa.RecordBatch:
            done = [(file, line, end, *(f[0] if f else (None,) * 3), *((f[1] if f else None) or (None,) * 3)) for line, end, f in answers(rows)]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate(kinds)], names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != file and rows:
                    yield close()
                    rows = []
                file = row[0]
                rows.append(row)
        if rows:
            yield close()

    names = ["a_file", "a_line", "a_end", "span", "o_line", "owner", "span2", "o_line2", "owner2"]
    kinds = [to_arrow_type(children.schema["file"].dataType), *[pa.int64()] * 8]
    n = int(children.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    long = lambda df: df.select("file", F.col("line").cast("long"), F.col("end_line").cast("long"), "id", "asks")
    spans = long(held).unionByName(long(asked)).repartition(n, "file").sortWithinPartitions("file")
    found = spans.mapInArrow(run, f"a_file {kind}, " + ", ".join(f"{c} long" for c in names[1:]))
    joined = children.where("id is not null").join(found, (F.col("file") == F.col("a_file")) & (F.col("line") == F.col("a_line")) & (F.col("end_line") == F.col("a_end")))
    own = F.col("owner") == F.col("id")
    best = F.when(own, F.struct(F.col("span2").alias("span"), F.col("o_line2").alias("o_line"), F.col("owner2").alias("owner"))).otherwise(F.struct("span", "o_line", "owner"))
    rows = joined.select(F.col("id").alias("child"), best.alias("best")).where("best.owner is not null")
    return rows.groupBy("child").agg(F.min("best").alias("best")).select("child", F.col("best.owner").alias("owner"))


def nearest(rows: DataFrame, line: int, by: tuple[str, ...]) -> DataFrame:
    """Of each group the row nearest to a line, the first of equals."""
    w = Window.partitionBy(*by).orderBy(F.abs(F.col("line") - line), "line", "id")
    return rows.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def block_edges(edges: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file, caller, callee, calls) of references between definitions of one file, and (file, caller, name, calls) of all others."""
    s = defs(symbols)
    joined = edges.join(s.select(F.col("id").alias("container"), F.col("name").alias("caller"), "file"), "container")
    own = s.select("file", "name").distinct().withColumn("own", F.lit(True))
    counted = joined.groupBy("file", "caller", "name").agg(F.count("*").alias("calls")).join(own, ["file", "name"], "left")
    return counted.where("own").select("file", "caller", F.col("name").alias("callee"), "calls"), counted.where("own is null").select("file", "caller", "name", "calls")


def modal(rows: DataFrame, by: tuple[str, ...], values: tuple[str, ...], order: str) -> DataFrame:
    """(by..., values...): the most frequent combination of each group, the first seen of equals."""
    counted = rows.groupBy(*by, *values).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    best = counted.groupBy(*by).agg(F.max_by(F.struct(*values), F.struct("n", (-F.col("first")).alias("f"))).alias("m"))
    return best.select(*by, *(F.col("m")[v].alias(v) for v in values))


def first_difference(rows: DataFrame, modes: DataFrame, by: tuple[str, ...], values: tuple[str, ...]) -> DataFrame:
    """The rows with `reason`: the first of the values in which a row differs from its group's mode; null if in none."""
    m = modes.select(*by, *(F.col(v).alias(f"mode_{v}") for v in values))
    reason = F.coalesce(*(F.when(~F.col(v).eqNullSafe(F.col(f"mode_{v}")), F.lit(v)) for v in values))
    return rows.join(m, list(by)).withColumn("reason", reason).drop(*(f"mode_{v}" for v in values))


def longest_prefix(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, root): the longest root that a path lies under. A path is cut into its own prefixes, so the join is by equality."""
    parts = F.split("path", "/")
    ups = paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("root"))
    hit = ups.join(roots.select("root").distinct(), "root").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    return paths.join(hit, "path", "left")
