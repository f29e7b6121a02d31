"""Approximate neighbours against all pairs: recall, exact distances, hard cases."""

from __future__ import annotations

import math

import numpy as np

from spindrift.llm import common, neighbours, queries

SF = "/root/testdata/sf0.001"


def exact(rows, k, is_query):
    """{query id: [(distance, id)]} over (id, vector) rows that take part."""
    rows = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)]
    out = {}
    for at, (q, x) in enumerate(rows):
        if is_query(q):
            out.setdefault(q, []).append(sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for other, (i, y) in enumerate(rows) if other != at)[:k])
    return out


def checked(got, want, k, rows, least):
    """Recall; ranks and scores have to be right for what was found."""
    by, hit, total = {}, 0, 0
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    assert set(by) == {q for q, answers in want.items() if answers[0]}
    for q, found in by.items():
        found = sorted(found)
        assert [r for r, *_ in found] == [i + 1 for i in range(len(want[q][0])) for _ in want[q]]
        assert all(a[1] <= b[1] + 1e-12 for a, b in zip(found, found[1:]))
        limit = want[q][0][-1][0]
        hit += sum(d <= limit * (1 + 1e-12) for _, d, _ in found)
        total += len(found)
    assert hit >= least * total
    return hit / max(1, total)


def test_query_has_the_recall_and_exact_distances(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in common.table(spark, SF, "embeddings").collect()]
    got = queries.QUERIES["op12_nearest_neighbours"](spark, SF).collect()
    checked(got, exact(rows, 10, lambda i: i % 100 == 0), 10, rows, 0.9)
    vec = {i: np.array(v, np.float64) for i, v in rows}
    assert all(r["query_id"] != r["vec_id"] and abs(r["score"] - np.sqrt(((vec[r["query_id"]] - vec[r["vec_id"]]) ** 2).sum())) < 1e-12 for r in got)


def test_clusters_copies_and_hard_rows(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 24)) * 10
    data = [(i, (centres[i % 40] + rng.standard_normal(24) * 0.3).tolist()) for i in range(1800)]
    data += [(i, [1.0] * 24) for i in range(1800, 2600)]  # a third are copies of one vector
    data += [(2600 + i, (np.ones(24) + 1e-4 * rng.standard_normal(24)).tolist()) for i in range(400)]  # and as many nearly are
    data += [(3000, None), (3100, []), (3200, [0.0] * 24), (3300, [float("nan")] * 24), (3400, [None] * 24), (3500, [1.0, 2.0]), (None, [1.0] * 24)]
    frame = spark.createDataFrame([(*r, "x") for r in data], "vec_id long, embedding array<double>, rank string")
    got = neighbours.nearest(frame, "id % 50 = 0").collect()
    rows = [r for r in data if r[0] is not None and r[0] < 3000]
    checked(got, exact(rows, 10, lambda i: i % 50 == 0), 10, rows, 0.9)
    copies = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == 1850)
    assert [v for _, v in copies] == list(range(1800, 1810))  # ties to the smaller id
    assert {r["query_id"] for r in got}.isdisjoint({3000, 3100, 3200, 3300, 3400, 3500})


def test_few_rows(spark):
    for rows in ([], [(100, [1.0, 0.0])], [(100, [1.0, 0.0]), (100, [1.0, 0.0]), (7, [0.0, 1.0])]):
        got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "id % 100 = 0").collect()
        found = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got)
        assert found == ([(100, 1, 100), (100, 1, 100), (100, 2, 7), (100, 2, 7)] if len(rows) == 3 else [])
