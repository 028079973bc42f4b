"""Operators on fixtures: what the driver's tables don't show."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lexigraph.functions import paths, text
from lexigraph.operators import edits, events, extract, fusion, graph, lexical, scan, versions, windows
from lexigraph.sources import event_log, files, python_source
from lexigraph.streaming import metrics, turns


def test_one_document_and_unknown_terms(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, None), (3, "")], "doc_id long, text string")
    ask = lambda q: lexical.query_terms(spark.createDataFrame([(0, q)], "query int, text string"))
    t = lexical.tokenised(docs)
    assert lexical.entropy_bm25(t, ask("nothing here")).collect() == []
    assert [r.doc for r in lexical.entropy_bm25(t, ask("beta unknown")).collect()] == [1]
    size = lexical.corpus_size(t).first()
    assert (size.n, size.avgdl) == (3, 1.0)  # documents without words count
    assert lexical.entropy_bm25(t.limit(0), ask("beta")).collect() == []


def test_tolerance_is_from_the_first(spark):
    rows = [("q", "a", 1.0, 1), ("q", "b", 0.96, 2), ("q", "c", 0.95, 9), ("q", "d", 0.92, 1), ("q", "e", 0.89, 5)]
    df = spark.createDataFrame(rows, "query string, key string, score double, specificity int")
    got = fusion.tolerance_groups(df, ("query",)).orderBy("position").collect()
    assert [(r.key, r.group) for r in got] == [("b", 1), ("a", 1), ("c", 2), ("d", 2), ("e", 3)]


def test_missing_side_of_a_fusion(spark):
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "query string, doc string, rank int")
    b = spark.createDataFrame([("q", "z", 1)], "query string, doc string, rank int")
    got = {r.doc: r.score for r in fusion.weighted_rrf(a, b, 0.5).collect()}
    assert got == pytest.approx({"x": 0.5 / 11 + 0.5 / 12, "y": 0.5 / 12 + 0.5 / 12, "z": 0.5 / 13 + 0.5 / 11})


def test_nearest_rank_is_not_percentile_disc(spark):
    df = spark.createDataFrame([(1, float(x)) for x in (1, 2, 3, 4)], "g int, v double")
    assert df.agg(events.nearest_rank(F.col("v"), 0.5).alias("p")).first().p == 3
    assert events.nearest_rank_of(df, ("g",), "v", {"p": 0.5}).first().p == 3


def test_intervals(spark):
    df = spark.createDataFrame([(1, 5, 9), (1, 1, 3), (1, 4, 4), (1, 20, 20), (2, 7, 8)], "d int, start int, end int")
    assert sorted(map(tuple, windows.merged_intervals(df, ("d",)).collect())) == [(1, 1, 9), (1, 20, 20), (2, 7, 8)]


def test_qualified_names(spark):
    symbols = spark.createDataFrame([(1, "A", "def", "f", None), (2, "B", "def", "f", 1), (3, "m", "def", "f", 2), (4, "B", "def", "g", None), (5, "m", "def", "g", 4), (6, "loop", "def", "g", 7), (7, "back", "def", "g", 6)], "id long, name string, kind string, file string, parent long")
    edges = spark.createDataFrame([(9, "A.B.m"), (9, "B.m"), (9, "C.m"), (9, "back.loop")], "container long, name string")
    got = {r.name: r.callee for r in graph.resolved_qualified(edges, symbols).collect()}
    assert got == {"A.B.m": 3, "B.m": None, "C.m": None, "back.loop": 6}


def test_impact_in_a_cycle(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "c"), ("c", "d"), ("d", None)], "caller string, callee string")
    assert {r.name: r.depth for r in graph.impact(pairs, "a", depth=5).collect()} == {"b": 1, "c": 2, "d": 3}
    assert {r.name: r.depth for r in graph.impact(pairs, "d", depth=1, reverse=True).collect()} == {"c": 1}


def test_rank_ends_when_it_rests(spark):
    links = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("c", "a", 2.0)], "src string, dst string, w double")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "node string")
    r = {x.node: x.rank for x in graph.pagerank(links, nodes, rounds=40).collect()}
    assert sum(r.values()) == pytest.approx(1) and r["a"] > r["b"] > r["c"] and r["c"] == pytest.approx(r["d"])


def test_versions(spark):
    old = spark.createDataFrame([(1, "f", "h"), (2, None, "h")], "s int, f string, h string")
    new = spark.createDataFrame([(1, "f", "h"), (2, None, "h"), (3, "g", "h"), (3, "g", "h")], "s int, f string, h string")
    assert versions.insert_or_ignore(old, new, ("s", "f", "h"), [F.col("s")]).count() == 4
    child = spark.createDataFrame([(1, 10), (2, 20)], "p int, c int")
    gone = spark.createDataFrame([(1,)], "id int")
    assert versions.without_children(child, gone, "p", "id").collect() == [(2, 20)]
    assert sorted(versions.nulled(child, gone, "p", "id").collect(), key=str) == [(2, 20), (None, 10)]


def brute_drops(weights, eligible, low, high, first):
    best, n = None, len(weights)

    def go(at, saved, any_):
        nonlocal best
        if any_ and low <= saved <= high and (best is None or saved < best):
            best = saved
        for s in range(at, n):
            for e in range(s + 6, n + 1):
                if not all(eligible[s:e]):
                    break
                go(e + 6, saved + sum(weights[s:e]) - extract.marker_size(first + s, first + e - 1), True)

    go(0, 0, False)
    return best


def test_drops_are_the_best():
    r = random.Random(5)
    for _ in range(300):
        n = r.randrange(1, 26)
        w, el = [r.choice((0, 3, 8, 20, 40)) for _ in range(n)], [r.random() < 0.85 for _ in range(n)]
        low = max(1, int(sum(w) * r.choice((0.1, 0.28, 0.3))))
        high, first = low + r.choice((0, 2, 5, 20)), r.choice((1, 5, 95))
        runs, saved, ok = extract.choose_drops(w, el, low, high, first)
        best = brute_drops(w, el, low, high, first)
        assert (saved, ok) == (best or 0, best is not None)
        assert all(e - s >= 6 and all(el[s:e]) for s, e in runs) and all(c - b >= 6 for (_, b), (c, _) in zip(runs, runs[1:]))


def test_drops_with_coarse_sizes():
    r = random.Random(1)
    w = [r.randrange(20, 90) for _ in range(300)]
    low, high = int(sum(w) * 0.28), int(sum(w) * 0.32)
    runs, saved, ok = extract.choose_drops(w, [True] * 300, low, high, room=100_000)
    assert ok and low <= saved <= high
    assert extract.choose_drops(w, [False] * 300, low, high) == ([], 0, False)


def test_coverage():
    terms = {0: {"a": 1.0, "b": 1.0}, 1: {"a": 1.0, "b": 1.0}, 2: {"c": 1.0}}
    assert extract.covered([(0, 0.4), (1, 0.39), (2, 0.3)], terms) == [0, 2, 1]


def test_event_log(spark, tmp_path):
    e = {"sessionId": "s", "turnNumber": 1, "timestamp": 5.5, "activeToolIds": ["a"], "directToolCalls": [], "routerDescribes": [], "routerProxies": []}
    lines = [json.dumps(e), "", "{broken", json.dumps({"type": "alert", **e}), json.dumps({**e, "group": "shadow"}), json.dumps({k: v for k, v in e.items() if k != "turnNumber"}), json.dumps({**e, "timestamp": 9.0})]
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    assert event_log.read_log(spark, str(tmp_path)).count() == 2
    assert event_log.read_log(spark, str(tmp_path), since=6.0).count() == 1
    assert metrics.run_once(event_log.stream_log(spark, str(tmp_path)).select("sessionId", "timestamp")).count() == 2


def test_turns_stream_and_batch(spark, tmp_path):
    tools = ["a", "b", "c", "d", "e", "f"]
    rows = [(s, t, [tools[(s + t) % 3]], ["e"] if t % 2 else [], tools if t < 6 else tools[::-1], 2) for s in (1, 2) for t in range(1, 12)]
    df = spark.createDataFrame(rows, "session long, turn long, calls array<string>, proxies array<string>, ranked array<string>, k int")
    batch = sorted(map(tuple, turns.turns_batch(df).collect()))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = turns.turns_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), idle=None)
    assert sorted(map(tuple, metrics.run_once(stream).collect())) == batch
    assert any(p for _, _, p, *_ in batch) and any(d for _, _, _, d, _ in batch) and all(a for *_, a in batch)


def test_polling():
    got = turns.polling([(0, 1.0), (5, 0), (10, 0), (20, 0), (30, 0), (50, 2.0), (55, 2.0)])
    assert [x[1] for x in got] == [5, 5, 10, 10, 20, 5, 5] and [x[2] for x in got] == [True, False, False, False, False, True, False]


def test_python_symbols(spark):
    source = "import os, a.b as c\nfrom . import d\n\n@dec\ndef f(x, *y, k=1) -> int:\n    if x:\n        return g(x)\n\nclass C:\n    def _m(self):\n        pass\n"
    df = spark.createDataFrame([("m.py", source), ("bad.py", "def f(:\n"), ("x.rs", "fn main")], "path string, text string")
    got = {r.path: r for r in python_source.parsed(df).collect()}
    assert [(s.name, s.kind, s.type, s.line, s.end_line, s.parent) for s in got["m.py"].symbols] == [("f", "def", "function", 4, 7, None), ("g", "ref", "call", 7, 7, "f"), ("C", "def", "class", 9, 11, None), ("_m", "def", "method", 10, 11, "C")]
    assert got["m.py"].symbols[0].params == ["x", "y", "k"] and [i.local for i in got["m.py"].imports] == ["os", "c", "d"] and [a.kind for a in got["m.py"].anchors] == ["if", "return"]
    assert got["bad.py"].error.startswith("line 1") and got["x.rs"].error
    assert {r.name: r.visibility for r in python_source.symbol_table(python_source.parsed(df)).collect()}["_m"] == "private"


def test_edits():
    t = "a\n  b  \n    c\nd"
    assert edits.find(t, "b\nc") == (1, 3, "indent") and edits.find(t, "  b\n    c") == (1, 3, "trimmed") and edits.find(t, "x") is None
    assert edits.apply_edits(t, [("b", "x\ny")]) == ("a\n  x\n  y\n    c\nd", []) and edits.apply_edits(t, [("a", "z"), ("no", "z")])[0] is None
    assert edits.replace_symbols("1\n2\n3\n4", [(3, 3, "c"), (1, 2, "")]) == ("c\n4", []) and edits.replace_symbols("1\n2", [(1, 2, ""), (2, 2, "x")])[0] is None
    assert edits.resumed(["a", "b", "c"], ["b", "c", "d"]) == ["d"] and edits.payload("f 1,2 ack:3") == ("f", [1, 2], 3)
    assert edits.find_block(["x {", "a", "}", "x {", "b", "}"], "x {", "}", ["b"]) == (3, 6) and "-a" in edits.diff("a\nb", "b")


def test_globs(spark):
    rows = spark.createDataFrame([("src/a/b.ts",), ("b.ts",), ("src/.env.local",), ("node_modules/x/a.js",), ("src/a.min.js",), ("keys/ID_RSA",)], "p string")
    at = lambda c: [r[0] for r in rows.where(c).collect()]
    assert at(paths.matches_glob(F.col("p"), "**/*.ts")) == ["src/a/b.ts", "b.ts"] and at(paths.matches_glob(F.col("p"), "src/*/[a-c].{ts,js}")) == ["src/a/b.ts"]
    assert at(paths.is_sensitive(F.col("p"))) == ["src/.env.local", "keys/ID_RSA"] and at(paths.is_excluded(F.col("p"))) == ["node_modules/x/a.js", "src/a.min.js"]


def test_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "f2.py").write_text("x = 1\n")
    (tmp_path / "src" / "f10.py").write_text("y = 2\n")
    (tmp_path / "a.png").write_bytes(b"\x89PNG")
    (tmp_path / ".env").write_text("secret")
    listed = files.listing(spark, str(tmp_path))
    assert sorted(r.relative for r in files.indexable(spark, str(tmp_path)).collect()) == ["src/f10.py", "src/f2.py"]
    assert [r.relative for r in files.found(spark, str(tmp_path), name="*.png").collect()] == ["a.png"]
    assert files.media(spark, str(tmp_path), "*.png").first().mime == "image/png"
    assert [(r.parent, r.name) for r in files.tree(listed.where("name != '.env'")).collect()] == [("", "src"), ("", "a.png"), ("src", "f2.py"), ("src", "f10.py")]
    asked = files.contents(spark, str(tmp_path), glob="*.py")
    wanted = asked.select("path").union(spark.createDataFrame([("gone",)], "path string"))
    assert sum(r.error is not None for r in files.read_many(spark, wanted, asked).collect()) == 1


def test_lines(spark):
    df = spark.createDataFrame([(1, "a\r\nb\n"), (2, ""), (3, None), (4, "x\n\n")], "doc_id long, text string")
    got = [(r.doc, r.line, r.text) for r in scan.text_lines(df).orderBy("doc", "line").collect()]
    assert got == [(1, 1, "a\r"), (1, 2, "b"), (2, 1, ""), (4, 1, "x"), (4, 2, "")]
    assert spark.range(1).select(text.unix_lines(F.lit("a\r\nb\rc"))).first()[0] == "a\nb\nc"


def test_turn_rules():
    """The turn machine against the rules written out one by one, on random sessions."""
    r = random.Random(11)
    tools = list("abcdefghijkl")
    for _ in range(60):
        k, state = r.randrange(1, 6), turns.fresh()
        active, low, proxied, before = [], {}, [], set()
        for turn in range(1, 25):
            ranked = r.sample(tools, r.randrange(3, 12))
            calls, proxies = r.sample(tools, r.randrange(3)), r.sample(tools[:4], r.randrange(3))
            state = turns.advance(state, calls, proxies, ranked, k)
            new = [t for t in ranked[: max(1, k - 2)] if t not in active]
            for t in tools:
                if t not in active + new and sum(p == t and n >= turn - 3 for n, p in proxied) >= 2:
                    new.append(t)
            assert sorted(state["promoted"]) == sorted(new)
            active += state["promoted"]
            gone = []
            for t in active if turn > 1 else []:
                place = ranked.index(t) if t in ranked else len(ranked)
                low[t] = low.get(t, 0) + 1 if place >= k + 3 else 0
                if low[t] > 1 and t not in before and len(gone) < 3:
                    gone.append(t)
            assert state["demoted"] == gone
            for t in gone:
                active.remove(t)
                del low[t]
            assert sorted(state["shown"]) == sorted(active)
            proxied += [(turn, p) for p in proxies]
            before = {*calls, *proxies}


def test_row_and_json_functions(spark):
    from lexigraph.functions import documents as d

    rows = [('{"b": [1, {"description": "x", "z": "s"}], "a": "\u00e9", "description": "top"}',), ("not json",), (None,), ("[]",), ('"t"',)]
    c = F.col("j")
    got = spark.createDataFrame(rows, "j string").select(d.canonical(c).alias("c"), d.without_descriptions(c).alias("w"), d.string_values(c).alias("s"), d.parameter_names(c).alias("p"), d.token_estimate(F.coalesce(c, F.lit(""))).alias("t")).collect()
    assert got[0].c == '{"a":"é","b":[1,{"description":"x","z":"s"}],"description":"top"}' and got[0].w == '{"b":[1,{"z":"s"}],"a":"é"}' and sorted(got[0].s) == ["s", "top", "x", "é"] and got[0].p == []
    assert [x.c for x in got[1:]] == [None, None, "[]", '"t"'] and [x.t for x in got[1:4]] == [2, 1, 1]
    shown = spark.createDataFrame([("a\tb\n\r\x01\x7f é",)], "t string").select(d.escaped(F.col("t"))).first()[0]
    assert shown == "a\\tb\\n\\r\\x01\\x7f é"


def test_payloads(spark):
    from lexigraph.operators import store

    text = "one 1, 2 ack:3\nbody a\nmore\n\ntwo.x 7\nbody b\nno header here\n"
    got = store.payload_groups(spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "nothing 1")], "id long, payload string"), "id", "payload").collect()
    assert [(r.id, r.symbol, r.indices, r.ack, r.body) for r in got] == [(1, "one", [1, 2], [3], "body a\nmore"), (1, "two.x", [7], [], "body b\nno header here")]


def test_sizes_up_to_a_unit(spark):
    sizes = [(1023,), (1024,), (1 << 20,), ((1 << 30) - 1,), (1 << 30,), (5 << 40,), (0,), (-5,)]
    n = spark.createDataFrame(sizes, "n long").coalesce(1)
    got = [tuple(r) for r in n.select(text.readable_size(n.n, largest="MB"), text.readable_size(n.n)).collect()]
    assert got == [
        ("1023 B", "1023 B"), ("1.00 KB", "1.00 KB"), ("1.00 MB", "1.00 MB"), ("1024.00 MB", "1024.00 MB"), ("1024.00 MB", "1.00 GB"), ("5242880.00 MB", "5.00 TB"), ("0 B", "0 B"), ("-5 B", "-5 B"),
    ]


def test_innermost_by_a_sweep(spark):
    """Against all pairs: equal spans, one id on several spans, nulls; and no row for each bucket or pair."""
    r = random.Random(5)
    rows = [(r.randrange(150), r.choice(("a", "b", None)), a := r.randrange(40), a + r.randrange(-1, 30)) for _ in range(300)] + [(None, "a", 1, 2), (400, "a", None, 3), (401, "a", 0, 10**9)]
    df = spark.createDataFrame(rows, "id long, file string, line long, end_line long")
    got = {x.child: x.owner for x in graph.innermost(df, df).collect()}
    want = {}
    for i, f, a, b in rows:
        fit = [(y - x, x, j) for j, g, x, y in rows if None not in (i, j, a, x) and f is not None and f == g and x <= a and y >= b and i != j]
        if fit:
            want[i] = min([min(fit), *([want[i]] if i in want else [])])
    assert got == {i: o[2] for i, o in want.items()}
    assert "Generate" not in graph.innermost(df, df)._jdf.queryExecution().executedPlan().toString()


ODD = [(1, None), (2, ""), (3, "\n"), (4, "a b\n\na c\n"), (5, " \n!!\n"), (6, "x y\nz"), (6, "x\nw w\n\nq"), (None, "n m\nn"), (7, "\n".join(f"word{i % 7} other{i % 5} line{i} Äé_ß" for i in range(60)) + "\n")]


def _odd(spark, tmp_path):
    import duckdb

    spark.createDataFrame(ODD, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    other = duckdb.connect()
    other.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    return other


@pytest.mark.parametrize("name", ["bmxplus_line_scores", "bmxplus_core_knee", "block_coverage_order", "compress_invariants", "compress_documents"])
def test_documents_by_themselves(spark, tmp_path, name):
    """Nulls, empty texts and rows of one id as SQL has them, and at most the texts, lines' scores and blocks' places are dealt out."""
    from lexigraph.plans import catalogue

    other = _odd(spark, tmp_path)
    got = catalogue.QUERIES[name](spark, str(tmp_path))
    columns = got.columns
    if name in catalogue.ORACLES and not name.startswith("compress"):
        want = other.sql(catalogue.ORACLES[name])
        at = [want.columns.index(c) for c in columns]
        assert sorted(str(tuple(r)) for r in got.collect()) == sorted(str(tuple(r[k] for k in at)) for r in want.fetchall())
    else:
        assert len(got.collect()) == len(ODD)
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange") <= {"bmxplus_line_scores": 1, "bmxplus_core_knee": 2, "block_coverage_order": 3}.get(name, 0), plan


def test_inside_as_the_plans_say(spark):
    from lexigraph.functions.text import unicode_tokens

    docs = spark.createDataFrame([x for x in ODD if x[0] not in (None, 6)], "doc_id long, text string")
    units = lexical.tokenised(extract.blocks(docs), "block", "text", unicode_tokens, ("doc_id",))
    weights = extract.weighted_postings(units, ("doc_id",))
    ranks = extract.document_ranks(extract.similarity_edges(weights, ("doc_id",)), units)
    want = sorted(map(tuple, extract.coverage_order(ranks, weights).collect()))
    assert sorted(map(tuple, extract.coverage(docs).collect())) == want
    assert {r.doc_id: r.within_band for r in extract.compressed(docs).collect()}[2]


def test_contained_by_reach(spark):
    """Names of one to three parts against all chains: one id in two files, equal spans, empty parts."""
    from lexigraph.operators import store

    r = random.Random(6)
    rows = [(r.randrange(70), r.choice("xyz"), "def", r.choice("fg"), a := r.randrange(20), a + r.randrange(12)) for _ in range(90)]
    df = spark.createDataFrame(rows, "id long, name string, kind string, file string, line long, end_line long")
    names = ["x", "x.y", "y..x", "z.z", "x.y.z", "y.y.y", "q.x"]
    got = sorted(map(tuple, store.contained(df, spark.createDataFrame([(n,) for n in names], "dotted string")).collect()))
    want = set()
    for name in names:
        first, *rest = [p for p in name.split(".") if p]
        now = {x for x in rows if x[1] == first}
        for p in rest:
            now = {y for y in rows if y[1] == p and any(x[3] == y[3] and x[4] <= y[4] and x[5] >= y[5] and x[0] != y[0] for x in now)}
        want |= {(name, x[0]) for x in now}
    assert got == sorted(want)
    assert "Generate" not in store._within(df.withColumnRenamed("name", "key"), df, spark.createDataFrame([("x", "y", "x.y")], "key string, name string, out string"), True)._jdf.queryExecution().executedPlan().toString()
