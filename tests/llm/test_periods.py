"""Periodic runs against every pair of positions, and the registered query against a plain computation."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from spindrift.llm import common, periods, queries

SF = "/root/testdata/sf0.001"


def brute(words, least=6, times=4):
    """(start, length, period) of all runs: every period, every stretch of equal words at that distance."""
    n, out = len(words), []
    same = np.array(words)
    for q in range(1, n // times + 1):
        equal = np.r_[False, same[:-q] == same[q:], False]
        edge = np.flatnonzero(equal[1:] != equal[:-1])
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a + q >= max(least, times * q) and not any(s <= a and a + (b - a + q) <= s + n_ and q % p == 0 for s, n_, p in out):
                out.append((a, b - a + q, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("block", [1024, 2])
def test_runs_against_every_period(monkeypatch, block):
    monkeypatch.setattr(periods, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(400):
        n = rng.randint(0, 60)
        words = [rng.randrange(rng.choice([1, 2, 3])) + 1 for _ in range(n)]
        p = rng.randint(1, 9)
        words = [words[i % p] if n // 4 < i < n - rng.randint(0, 3) else w for i, w in enumerate(words)]
        for least, times in ((6, 4), (2, 2), (5, 3)):
            assert [tuple(r) for r in periods.runs(np.array([*words, 0]), least, times).tolist()] == brute(words, least, times)


def test_long_runs_take_little_more_than_their_length():
    found = periods.runs(np.array([*[7] * 50_000, 1, *[3, 4, 5] * 20_000, 0]))
    assert found.tolist() == [[0, 50_000, 1], [50_001, 60_000, 3]]


def test_hard_cases(spark):
    line = "one two three "
    rows = [(1, None, "x", "r"), (2, "", "x", "r"), (None, " \t\n", "x", "r"), (3, line * 5, "x", "r"), (3, line * 5, "x", "r"), (4, "a b " * 7, "x", "r"), (5, "ha " * 100_000 + "end", "x", "r"), (6, "no period here at all", "x", "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, collapsed string, runs string")
    got = periods.periodic(docs, keep=("doc_id", "collapsed", "runs"))
    assert got.columns == ["doc_id", "runs", "collapsed"]
    found = sorted(((r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got.collect()), key=str)
    want = [(1, [], ""), (2, [], ""), (None, [], ""), (3, [(0, 15, 3)], "one two three"), (3, [(0, 15, 3)], "one two three"), (4, [(0, 7, 1)], "a b"), (5, [(0, 100_000, 1)], "ha end"), (6, [], "no period here at all")]
    assert found == sorted(want, key=str)
    assert periods.periodic(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periods.periodic(docs, times=1)


def test_query_against_a_plain_computation(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in common.table(spark, SF, "documents").collect()}
    got = {r["doc_id"]: r for r in queries.QUERIES["op11_periodic_runs"](spark, SF).collect()}
    assert set(got) == set(docs)
    some = 0
    for d, text in docs.items():
        words = text.encode().split()
        h, n = zlib.crc32(str(d).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        code = {w: k for k, w in enumerate(dict.fromkeys(words))}
        found = brute([code[w] for w in words])
        some += len(found)
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
        gone = {i for s, m, q in found for i in range(s + q, s + m)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        r = got[d]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(found), *best)
        assert r["exponent_milli"] == (None if best[0] is None else 1000 * best[1] // best[2])
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(kept).hexdigest()
    assert some > 10
