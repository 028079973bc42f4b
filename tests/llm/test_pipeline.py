"""The pipeline's stages on a small corpus with planted cases."""

import random

import corpus_pipeline
from lexigraph.llm import queries


def test_stages(spark, tmp_path):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghi") for _ in range(r.randrange(3, 8)))
    texts, toxic = [], []
    for i in range(240):
        words = [word() for _ in range(120)]
        toxic.append(i % 6 == 0)
        if toxic[-1]:
            for _ in range(9):
                words[r.randrange(120)] = r.choice(("idiot", "moron", "scum"))
        texts.append(" ".join(words))
    clean = [i for i in range(240) if not toxic[i]]
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(texts)]
    copies = [(300 + k, f" {texts[i]}\n") for k, i in enumerate(clean[:20])]
    near = [(400 + k, texts[i] + " changed end") for k, i in enumerate(clean[20:40])]
    rows += [(i, t, "en", "s1", len(t)) for i, t in [*copies, *near]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(x), 1) for i, x in enumerate(toxic)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, ids = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        ids.append([x.doc_id for x in docs.select("doc_id").collect()])
        assert k == 4 or docs.columns == columns
    kept = set(ids[0])
    assert len(kept & set(clean)) >= 0.98 * len(clean) and len(kept & {i for i in range(240) if toxic[i]}) <= 4
    after = set(ids[1])
    for k, i in enumerate(clean[:20]):  # the longer text, the copy with blanks, stays
        assert 300 + k in after and (i not in after)
    last = set(ids[2])
    pairs = list(zip(clean[20:40], range(400, 420), strict=True))
    assert all(b not in last for a, b in pairs if a in after and b in after) and all(a in last for a, b in pairs if a in after)
    assert len(after - last) <= 21  # nothing else goes
    taken = ids[3]
    assert set(taken) <= last and max(taken.count(i) for i in set(taken)) <= 2 and len(taken) > len(last)
    assert sorted(ids[4]) == sorted(taken)
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(x.doc_id for x in again.collect()) == sorted(taken)


def test_registered():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 11))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
