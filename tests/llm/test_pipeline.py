"""The pipeline on a small table: stages, columns, decisions."""

from __future__ import annotations

import random

import corpus_pipeline
from spindrift.llm import common, shingles, simhash


def test_stages_and_run(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = common.table(spark, sf, "documents")
    names = docs.columns
    assert len(corpus_pipeline.STAGES) == 5
    seen, before = docs, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        seen = common.written(stage(spark, seen, sf), f"test-stage-{k}")
        assert seen.columns == names and seen.count() <= before
        before = seen.count()
        if k == 2:
            left = simhash.with_components(seen).groupBy("component_id").count().where("count > 1").count()
            assert left == 0
    out = corpus_pipeline.run(spark, sf)
    assert out.count() == before > 100
    text = " ".join(r["text"] for r in seen.select("text").collect())
    assert "[EMAIL]" in text or "[PHONE]" in text or "[IP]" in text


def test_pipeline_of_nothing_and_of_hard_cases(spark):
    sf = "/root/testdata/sf0.001"
    docs = common.table(spark, sf, "documents")
    hard = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "The thing was there and then it went.", "en", "s", 5)], docs.schema)
    for start in (docs.limit(0), hard):
        seen = start
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            seen = common.written(stage(spark, seen, sf), f"test-hard-{k}")
        assert seen.count() <= start.count()


def test_near_duplicate_stage_is_brute_force_jaccard(spark, monkeypatch):
    monkeypatch.setattr(shingles, "BUCKET", 500)
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(40)]
    texts = [None, "", " \n", "one two", "ONE  two", "one two three", "é ü 日本"]
    for k in range(40):
        base = [f"d{k}w{i}" for i in range(rng.choice([5, 9, 30, 60, 150]))] + passage * (k % 3 == 0)
        texts.append(" ".join(base))
        for _ in range(4):
            new = list(base)
            for _ in range(rng.randrange(5)):
                new[rng.randrange(len(new))] = f"x{rng.random()}"
            texts.append(" ".join(new[: rng.choice([len(new), len(new), len(new) * 9 // 10])]))
    near = [f"n{i}" for i in range(120)]
    for k in range(60):
        texts.append(" ".join(near[:k] + [f"c{k}"] + near[k + 1 :]))
    ids = rng.sample(range(1000), len(texts))
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    close = 0
    for i in range(len(texts)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if 5 * both >= 4 * either:
                close += both < either
                old, new = sorted((root[i], root[j]), reverse=True)
                root = [new if r == old else r for r in root]
    want = {min(ids[i] for i in range(len(texts)) if root[i] == r) for r in set(root)}
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in zip(ids, texts, strict=True)], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    assert close > 100
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()) == sorted(want)
    assert sorted(r["doc_id"] for r in shingles.deduplicated(docs, block=8).collect()) == sorted(want)


def test_pairs_of_a_large_group_are_not_rows(spark, monkeypatch):
    rng = random.Random(11)
    texts = []
    for group, (size, words, changes) in enumerate([(120, 600, (8,)), (90, 404, (4,)), (80, 100, (1,)), (20, 3000, (40, 37))]):
        base = [f"g{group}w{k}" for k in range(words)]
        for k in range(size):
            new = list(base)
            for at in rng.sample(range(words), changes[k % len(changes)]):
                new[at] = f"x{rng.random()}"
            texts.append(" ".join(new))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    root, linked, refused = list(range(len(texts))), 0, 0
    for i in range(len(texts)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            linked, refused = linked + (5 * both >= 4 * either), refused + (0.77 * either <= both < 0.8 * either)
            if 5 * both >= 4 * either and root[i] != root[j]:
                old, new = sorted((root[i], root[j]), reverse=True)
                root = [new if r == old else r for r in root]
    assert linked > 5000 and refused > 5000 and len(set(root)) == 54
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    made, write = [], common.written

    def counted(df, label):
        out = write(df, label)
        made.append((label, out.count()))
        return out

    monkeypatch.setattr(common, "written", counted)
    monkeypatch.setattr(shingles, "CELL", 60_000)
    assert sorted(r["doc_id"] for r in shingles.deduplicated(docs).collect()) == sorted(set(root))
    assert max(n for label, n in made if label in ("shingle-pairs", "shingle-links")) <= 3 * len(texts)
    assert made[[label for label, _ in made].index("shingle-trees")][1] <= dict(made)["shingle-entries"] // 4
