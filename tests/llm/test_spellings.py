"""Spelling variants against all pairs of words, and the registered query against a plain computation."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from spindrift.llm import common, queries, spellings

SF = "/root/testdata/sf0.001"


def apart_by_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def plain(n, times=10):
    """{word: (form, root, n, n_near, form_n)} by comparing each word with all of about its length."""
    by_size = {}
    for w in n:
        by_size.setdefault(len(w), []).append(w)
    near = {w: [v for k in (-1, 0, 1) for v in by_size.get(len(w) + k, []) if apart_by_one(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n.get(form[w]))
    return out


def told(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_pivots_are_the_lightest_disjoint_grams():
    rng = np.random.default_rng(3)
    place = np.sort(np.stack([rng.choice(9, 3, replace=False) for _ in range(300)]), axis=1)
    weight = rng.integers(1, 6, (300, 3))
    mask = spellings.pivots(place, weight)
    for p, w, m in zip(place, weight, mask):
        at = np.flatnonzero(m)
        assert len(at) == 2 and p[at[1]] - p[at[0]] >= 2
        assert w[at].sum() == min(w[i] + w[j] for i in range(3) for j in range(i + 1, 3) if p[j] - p[i] >= 2)


def test_one_apart():
    rng = random.Random(5)
    for _ in range(3000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 6))) for _ in range(2))
        assert spellings.one_apart(a, b) == apart_by_one(a, b)


@pytest.mark.parametrize("letters", ["ab", "abcé", "abcdefghij一\U0001f600"])
def test_pairs_against_all_pairs(spark, letters):
    rng = random.Random(len(letters))
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(4, 11))) for _ in range(300)}
    for w in list(words):
        for _ in range(4):
            k = rng.randrange(len(w))
            words.add(rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]]))
    n = {w: rng.choice([2, 3, 30, 400, 5000]) for w in sorted(words) if len(w) >= 4}
    got = told(spellings.variants(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert got == plain(n)


def test_hard_cases(spark):
    long = "abcdefgh" * 20_000
    rows = [(1, None), (2, ""), (None, "letters letters"), (3, "LETTERS lettes! Étoiles étoiles İstanbul"), (3, "LETTERS lettes! Étoiles étoiles İstanbul"), (4, long + " " + long), (5, long[:-1] + "\n" + long[:-1]), (6, "letterx letterx " + "letters " * 40)]
    docs = spark.createDataFrame([(*r, "w") for r in rows], "doc_id long, text string, word string")
    n = {"letters": 44, "étoiles": 2, "Étoiles": 2, "stanbul": 2, "letterx": 2, long: 2, long[:-1]: 2}
    assert told(spellings.grouped(docs)) == plain(n)
    assert spellings.grouped(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spellings.grouped(docs, least_letters=3)


def test_query_against_a_plain_computation(spark):
    n = Counter()
    for r in common.table(spark, SF, "documents").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{r['doc_id']}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    got = told(queries.QUERIES["op13_spelling_variants"](spark, SF))
    assert got == plain(n) and sum(f is not None for f, *_ in got.values()) > 5
