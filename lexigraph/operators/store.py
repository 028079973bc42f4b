"""Queries on the symbol store beyond the graph's: finding symbols, facts of a file, imports, dotted names, the tool registry, payloads.

symbols: id, name, kind, type, file, line, end_line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clamped(limit: int | None, default: int = 50, most: int = 500) -> int:
    """What a caller may ask for: 1 to `most`."""
    return max(1, min(default if limit is None else int(limit), most))


def find_symbols(symbols: DataFrame, *, kind: str | None = None, type_: str | None = None, file: str | None = None, prefix: str | None = None, part: str | None = None, limit: int | None = None) -> DataFrame:
    """Symbols by any of kind, type, file, the start of the file's path (as it is, in either case) and a part of the name (in either
    case), by name and id, as many as allowed."""
    found = symbols
    for column, value in (("kind", kind), ("type", type_), ("file", file)):
        if value is not None:
            found = found.where(F.col(column) == value)
    if prefix is not None:
        found = found.where(F.startswith(F.lower("file"), F.lit(prefix.lower())))
    if part is not None:
        found = found.where(F.contains(F.lower("name"), F.lit(part.lower())))
    return found.orderBy("name", "id").limit(clamped(limit))


def split_tag(tag: Column) -> tuple[Column, Column]:
    """(kind, type) of a capture tag: `name.definition.x` is a def of type x, `name.reference.x` a ref; others are neither."""
    inside = F.regexp_extract(tag, r"^name\.(definition|reference)\.(.*)$", 1)
    kind = F.when(inside == "definition", "def").when(inside == "reference", "ref")
    return kind, F.when(inside != "", F.regexp_extract(tag, r"^name\.(definition|reference)\.(.*)$", 2))


def visibility(modifiers: Column) -> Column:
    """What the modifiers of a definition say of who sees it, null if nothing."""
    has = lambda *names: F.arrays_overlap(modifiers, F.array(*map(F.lit, names)))
    return F.when(has("export", "public", "pub"), "public").when(has("private"), "private").when(has("protected"), "protected")


def of_symbols(rows: DataFrame, symbols: DataFrame, by: str = "symbol_id") -> DataFrame:
    """Anchors, scopes or structures (symbol_id, ...) with their symbol's name and file."""
    return rows.join(symbols.select(F.col("id").alias(by), F.col("name").alias("symbol_name"), "file"), by)


def importers(imports: DataFrame, module: str) -> DataFrame:
    """The files that import a module."""
    return imports.where(F.col("module") == module).select("file").distinct()


def import_groups(refs: DataFrame) -> DataFrame:
    """(file, module, names, line, end_line) from references (file, line, seq, type, name) where there is no syntax to read: a `module`
    opens a statement, the `import`s that follow are its names; an import before any module is a module by itself."""
    order = Window.partitionBy("file").orderBy("line", "seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = refs.where(F.col("type").isin("module", "import")).withColumn("g", F.sum((F.col("type") == "module").cast("int")).over(order))
    rows = rows.withColumn("own", F.when(F.col("g") == 0, F.struct("line", "seq")))
    first = F.min(F.struct("line", "seq", "name", "type")).alias("first")
    names = F.sort_array(F.collect_list(F.when((F.col("type") == "import"), F.struct("line", "seq", "name"))))
    found = rows.groupBy("file", "g", "own").agg(first, names.alias("names"), F.max("line").alias("end_line"))
    return found.select("file", F.col("first.name").alias("module"), F.transform("names", lambda x: x["name"]).alias("names"), F.col("first.line").alias("line"), "end_line")


def _within(owners: DataFrame, inner: DataFrame, pairs: DataFrame, final: bool) -> DataFrame:
    """(out, id), and file, line, end_line unless final: the inner symbols (id, name, file, line, end_line) that lie in another of the
    owners (key, id, file, line, end_line) of one key in the same file, for each of the pairs (key, name, out). Each file is one task's:
    of a key's owners the last end up to a line tells, so no inner symbol meets them one by one."""
    import numpy as np
    import pyarrow as pa

    files = owners.select("file", "key").distinct()
    asked = pairs.join(files, "key").join(inner.select("file", "name").distinct(), ["file", "name"])
    none = F.lit(None)
    long = [F.col(c).cast("long") for c in ("id", "line", "end_line")]
    rows = owners.select("file", F.lit(0).alias("kind"), "key", none.cast("string").alias("name"), none.cast("string").alias("out"), *long)
    rows = rows.unionByName(inner.select("file", F.lit(1).alias("kind"), none.cast("string").alias("key"), "name", none.cast("string").alias("out"), *long))
    rows = rows.unionByName(asked.select("file", F.lit(2).alias("kind"), "key", "name", "out", *(none.cast("long").alias(c) for c in ("id", "line", "end_line"))))

    def reach(spans: list[tuple[int, int, int]]) -> tuple:
        """By rising line: the line, the largest end so far, its id, and the largest of another id."""
        out, first, own, second = [], None, None, None
        for line, end, i in sorted(spans):
            if first is None or end > first:
                first, own, second = (end, i, first if own is not None and own != i else second)
            elif i != own and (second is None or end > second):
                second = end
            out.append((line, first, own, -(2**63) if second is None else second))
        return tuple(np.array(c, np.int64) for c in zip(*out, strict=True))

    def run(batches):
        file, spans, symbols, held, size = None, {}, {}, [], 0

        def flush() -> pa.RecordBatch:
            made = [pa.concat_arrays([pa.array([out] * len(x[0]), pa.string()) for _, out, x in held]), *(pa.array(np.concatenate([x[k] for _, _, x in held])) for k in range(3))]
            where = pa.concat_arrays([pa.array([f] * len(x[0]), pa.string()) for f, _, x in held])
            held.clear()
            return pa.RecordBatch.from_arrays(made[:2] if final else [*made, where], ["out", "id"] if final else ["out", "id", "line", "end_line", "file"])

        for batch in batches:
            for f, kind, key, name, out, i, line, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if f != file:
                    file, spans, symbols = f, {}, {}
                if kind == 0:
                    spans.setdefault(key, []).append((line, end, i))
                elif kind == 1:
                    symbols.setdefault(name, []).append((i, line, end))
                else:
                    if isinstance(spans[key], list):
                        spans[key] = reach(spans[key])
                    if isinstance(symbols[name], list):
                        symbols[name] = tuple(np.array(c, np.int64) for c in zip(*symbols[name], strict=True))
                    (lines, first, own, second), (ids, at, to) = spans[key], symbols[name]
                    k = np.searchsorted(lines, at, "right") - 1
                    hit = (k >= 0) & (np.where(own[k] != ids, first[k], second[k]) >= to)
                    if hit.any():
                        found = (np.unique(ids[hit]),) * 3 if final else (ids[hit], at[hit], to[hit])
                        held.append((file, out, found))
                        size += len(found[0])
                        if size > 50_000:
                            yield flush()
                            size = 0
        if held:
            yield flush()

    n = int(owners.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "file").sortWithinPartitions("file", "kind")
    return dealt.mapInArrow(run, "out string, id long" + ("" if final else ", line long, end_line long, file string"))


def contained(symbols: DataFrame, dotted: DataFrame) -> DataFrame:
    """(dotted, id): the symbols that a dotted name means by containment: its last part's definitions within one of the part before,
    and so on, in the same file. Names that begin alike go their common way once."""
    defs = symbols.where("kind = 'def'").select("id", "name", "file", "line", "end_line")
    parts = dotted.distinct().select("dotted", F.filter(F.split("dotted", r"\."), lambda x: x != "").alias("parts")).withColumn("n", F.size("parts"))
    longest = parts.agg(F.max("n")).first()[0] or 0
    start = lambda k: F.array_join(F.slice("parts", 1, k), ".")
    out = parts.where("n = 1").join(defs, F.col("name") == F.col("parts")[0]).select("dotted", "id").distinct()
    whole = defs.dropna().distinct()
    # Rows of an id in several files may give a name's symbol more than once.
    several = whole.groupBy("id").agg((F.min("file") != F.max("file")).alias("several")).where("several").select("id")
    once, again = whole.join(several, "id", "left_anti"), whole.join(several, "id", "left_semi")
    now = whole.select(F.col("name").alias("key"), "id", "file", "line", "end_line")
    for k in range(1, min(longest, 16)):
        ends = parts.where(F.col("n") == k + 1).select(start(k).alias("key"), F.col("parts")[k].alias("name"), F.col("dotted").alias("out"))
        found = _within(now, once, ends, True).unionByName(_within(now, again, ends, True).distinct())
        out = out.unionByName(found.select(F.col("out").alias("dotted"), "id"))
        if k + 1 < min(longest, 16):
            on = parts.where(F.col("n") > k + 1).select(start(k).alias("key"), F.col("parts")[k].alias("name"), start(k + 1).alias("out")).distinct()
            now = _within(now, whole, on, False).withColumnRenamed("out", "key")
    return out


def file_facts(symbols: DataFrame, resolved: DataFrame) -> DataFrame:
    """What is known of each file, one row: definitions (line, name, id), calls between two of its definitions (line, line, number), by
    identity and not by name, and references out of its definitions (line, name, number), each sorted. resolved: container, name,
    callee."""
    defs = symbols.where("kind = 'def'")
    end = lambda name: defs.select(F.col("id").alias(name), F.col("file").alias(f"{name}_file"), F.col("line").alias(f"{name}_line"))
    inside = resolved.select("container", "name", "callee").join(end("container"), "container")
    calls = inside.join(end("callee"), "callee").where("container_file = callee_file").groupBy(F.col("container_file").alias("file"), "container", "container_line", "callee", "callee_line").agg(F.count("*").alias("n"))
    refs = inside.groupBy(F.col("container_file").alias("file"), "container", "container_line", "name").agg(F.count("*").alias("n"))
    listed = lambda df, name, *c: df.groupBy("file").agg(F.sort_array(F.collect_list(F.struct(*c))).alias(name))
    out = listed(defs, "defs", "line", "name", "id").join(listed(calls, "calls", "container_line", "callee_line", "n"), "file", "left")
    return out.join(listed(refs, "references", "container_line", "name", "n"), "file", "left")


def merged_edges(similar: DataFrame, calls: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., a, b, w): a similarity graph, both ways, with calls laid over it: of the root of their number one part to the called, four
    to the caller. What isn't called both ways is then no longer the same both ways. similar: a, b, sim; calls: caller, callee, calls."""
    root = F.sqrt(F.col("calls").cast("double"))
    parts = [
        similar.select(*by, "a", "b", F.col("sim").alias("w")), similar.select(*by, F.col("b").alias("a"), F.col("a").alias("b"), F.col("sim").alias("w")),
        calls.select(*by, F.col("caller").alias("a"), F.col("callee").alias("b"), (root * 1.0).alias("w")), calls.select(*by, F.col("callee").alias("a"), F.col("caller").alias("b"), (root * 4.0).alias("w")),
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.where("a <> b").groupBy(*by, "a", "b").agg(F.sum("w").alias("w"))


def position_prior(rows: DataFrame, by: tuple[str, ...], order: str, centrality: str) -> DataFrame:
    """The rows with `prior`: more weight for the first the more central the lead is, and some for the last."""
    whole = Window.partitionBy(*by)
    rows = rows.withColumn("i", F.row_number().over(whole.orderBy(order)) - 1).withColumn("n", F.count("*").over(whole))
    lead_n = F.greatest(F.lit(3), F.floor(F.col("n") / 10))
    lead = F.sum(F.when(F.col("i") < lead_n, F.col(centrality)).otherwise(0.0)).over(whole) / lead_n
    mean = F.avg(centrality).over(whole)
    strength = F.when(mean > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (lead / mean - 1) * 2.5))).otherwise(0.0)
    prior = 1 + strength * F.exp(-F.col("i") / F.greatest(F.col("n") * 0.1, F.lit(1.0))) + 0.3 * F.exp(-(F.col("n") - 1 - F.col("i")) / F.greatest(F.col("n") * 0.05, F.lit(1.0)))
    return rows.withColumn("prior", F.when(F.col("n") <= 1, 1.0).otherwise(prior)).drop("i", "n")


def first_of_namespaces(registry: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(category, tool, score): for each category, of each namespace that it wants the first tool, the likely ones up to k in all.
    registry: namespace, tool; wanted: category, namespace, always, position."""
    first = registry.groupBy("namespace").agg(F.min("tool").alias("tool"))
    met = wanted.join(first, "namespace").withColumn("place", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("always"), "position")))
    return met.where(F.col("place") <= k).select("category", "tool", F.when(F.col("always"), 1.0).otherwise(0.8).alias("score"))


def project_type(tokens: Column, confidence: Column) -> Column:
    """What kind of project the evidence shows; the first rule that holds."""
    has = lambda *names: F.arrays_overlap(tokens, F.array(*map(F.lit, names)))
    # The evidence of each kind, in the order in which they are tried.
    return (
        F.when(has("infra:terraform", "infra:kubernetes", "manifest:Chart.yaml"), "infrastructure")
        .when(has("manifest:Cargo.toml", "lang:rust"), "rust_cli")
        .when(has("manifest:pyproject.toml", "lang:python"), "python_web")
        .when(has("manifest:package.json", "lang:javascript", "lang:typescript"), "node_web")
        .when(confidence >= 0.45, "generic")
    )


def catalogue_hash(tools: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by..., tools, schema_hash): of catalogues of tools (key, description, parameters), by key. A catalogue is what one server offers."""
    entry = F.to_json(F.struct(F.col("key").alias("k"), F.col("description").alias("d"), F.col("parameters").alias("p")))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("key", entry.alias("json")))), lambda x: x["json"])
    return tools.groupBy(*by).agg(F.count("*").alias("tools"), F.sha2(F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")), 256).alias("schema_hash"))


def retry_locks(failures: DataFrame, by: tuple[str, ...], order: tuple[str, ...], most: int = 2) -> DataFrame:
    """Failures with `attempt`, and `locked` from the second of a group on."""
    w = Window.partitionBy(*by).orderBy(*order)
    return failures.withColumn("attempt", F.row_number().over(w)).withColumn("locked", F.col("attempt") >= most)


def restorable(versions: DataFrame, session: str) -> DataFrame:
    """The latest version of each symbol that the session itself has saved."""
    w = Window.partitionBy("symbol").orderBy(F.desc("created"), "id")
    return versions.where(F.col("session") == session).withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def payload_groups(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, symbol, indices, ack, body) of payloads of blocks `symbol i,j ack:k` and the lines that follow; other blocks are left out."""
    blocks = F.split(payload, r"\n(?=[A-Za-z_$][\w$.]*\s+\d)")
    rows = rows.select(key, F.explode(blocks).alias("block")).where(F.contains(F.col("block"), F.lit("\n")))
    header, body = F.trim(F.substring_index("block", "\n", 1)), F.regexp_replace(F.expr("substring(block, instr(block, '\n') + 1)"), r"\n+$", "")
    form = r"^([A-Za-z_$][\w$.]*)\s+([\d,\s]+?)(?:\s+ack:([\d,\s]+))?$"
    numbers = lambda g: F.transform(F.filter(F.split(F.regexp_extract(header, form, g), ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("int"))
    return rows.where(header.rlike(form)).select(key, F.regexp_extract(header, form, 1).alias("symbol"), numbers(2).alias("indices"), numbers(3).alias("ack"), body.alias("body"))
