"""Periodic runs of words by descending-LCP Kruskal.

A run is a stretch of words with smallest period q, a number of times as long as q, that no neighbouring word extends with the same
period. The suffixes of a text are sorted by prefix doubling (only classes with several suffixes are sorted again); suffixes that
stand side by side are the edges of a forest, weighted by the length of their longest common prefix (LCP). The edges are united by
falling LCP; a class keeps its positions in an ordered set, the smaller set goes into the larger. Two positions that become
neighbours in a set at LCP l, no more than l apart, seed a run: their distance is its period, distance + l its length. Whatever
stands left of both differs, or the run began earlier. Every run arises once: its first position and the one a period later are
neighbours in the class of their LCP, as a position between them would give the run a smaller period.

Only suffixes whose first words occur again in the text take part, so that plain prose costs little more than splitting it. All
texts of a slice are sorted together, each closed by a word of its own. Nothing is shuffled: a text is one row, and memory is in
proportion to the words of a slice, or of the longest text if that is larger (about 150 bytes a word).
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections import defaultdict
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Words in a run, and times that it is as long as its period, at least.
LEAST_WORDS, TIMES = 6, 4
#: Positions in a block of an ordered set.
BLOCK = 1024

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Positions:
    """Ordered set of positions in blocks, so that an insertion moves few of them whatever the size of the set."""

    def __init__(self, values: list[int]):
        self.blocks = [values[at : at + BLOCK] for at in range(0, len(values), BLOCK)]
        self.heads = [b[0] for b in self.blocks]
        self.size = len(values)

    def __len__(self) -> int:
        return self.size

    def __iter__(self):
        for block in self.blocks:
            yield from block

    def around(self, x: int) -> tuple[int | None, int | None]:
        """The neighbours that ``x`` has, or would have, in the set."""
        k = bisect_right(self.heads, x) - 1
        if k < 0:
            return None, self.heads[0]
        block = self.blocks[k]
        at = bisect_right(block, x)
        after = block[at] if at < len(block) else self.heads[k + 1] if k + 1 < len(self.heads) else None
        return block[at - 1], after

    def add(self, x: int) -> None:
        k = max(0, bisect_right(self.heads, x) - 1)
        block = self.blocks[k]
        insort(block, x)
        self.size += 1
        self.heads[k] = block[0]
        if len(block) > 2 * BLOCK:
            self.blocks[k : k + 1] = [block[:BLOCK], block[BLOCK:]]
            self.heads.insert(k + 1, block[BLOCK])


def least_lcp(least: int, times: int) -> int:
    """The smallest LCP that seeds any run of ``least`` words, ``times`` its period."""
    return min(max((times - 1) * d, least - d, 1) for d in range(1, max(2, least) + 1))


def sorted_suffixes(symbols: np.ndarray, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, class) of the suffixes that share their first ``prefix`` symbols (a power of two) with another, sorted.

    ``class`` numbers the suffixes that share them. The sequence has to end with symbols that occur once.
    """
    order = np.argsort(symbols, kind="stable")
    rank = np.empty(len(symbols), np.int64)
    active, head = order, np.zeros(len(order), np.int64)
    part = symbols[order]
    k, deep, group = 0, None, None
    while True:
        new = np.r_[True, part[1:] != part[:-1]] if len(part) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        size = np.diff(np.r_[at, len(part)])
        rank[active] = head + np.repeat(at, size)
        many = np.repeat(size > 1, size)
        active = active[many]
        k = 2 * k or 1
        if k == prefix:
            deep, group = active, rank[active]
        if not len(active):
            break
        key = rank[active] * len(symbols) + rank[active + k]
        again = np.argsort(key, kind="stable")
        active, part = active[again], key[again]
        old = rank[active]
        first = np.flatnonzero(np.r_[True, old[1:] != old[:-1]])
        head = np.repeat(old[first] - first, np.diff(np.r_[first, len(old)]))  # what a place among the active ones lacks to a rank
    if deep is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    again = np.argsort(rank[deep])
    return deep[again], group[again]


def edges(symbols: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(LCP, position, position) of suffixes that stand side by side and share ``least`` symbols or more, by falling LCP."""
    prefix = 1 << (least.bit_length() - 1)
    suffix, group = sorted_suffixes(symbols, prefix)
    if not len(suffix):
        return suffix, suffix, suffix
    before = np.r_[-1, np.where(group[1:] == group[:-1], suffix[:-1], -1)]
    by_place = np.argsort(suffix)
    own, other = suffix[by_place], before[by_place]
    text, shared, h, last = symbols.tolist(), [], 0, -2
    for i, j in zip(own.tolist(), other.tolist(), strict=True):
        if j < 0:
            h = 0
        else:
            h = max(h - 1, prefix) if i == last + 1 else prefix
            while text[i + h] == text[j + h]:
                h += 1
        shared.append(h)
        last = i
    shared = np.array(shared, np.int64)
    some = np.flatnonzero(shared >= least)
    some = some[np.argsort(-shared[some], kind="stable")]
    return shared[some], own[some], other[some]


def runs(symbols: np.ndarray, least: int = LEAST_WORDS, times: int = TIMES) -> np.ndarray:
    """(start, length, period) of every run of at least ``least`` symbols and ``times`` its period (2 or more), in order of start and period.

    Each text among the symbols has to end with a symbol that occurs once.
    """
    root: dict[int, int] = {}
    members: dict[int, list | Positions] = {}
    text, found = symbols, []

    def top(x: int) -> int:
        r = x
        while (y := root.get(r, r)) != r:
            r = y
        while (y := root.get(x, x)) != r:
            root[x], x = r, y
        return r

    def seed(x: int, y: int, shared: int) -> None:
        d = y - x
        if d * (times - 1) <= shared and d + shared >= least and (not x or text[x - 1] != text[y - 1]):
            found.append((x, d + shared, d))

    for shared, i, j in zip(*(e.tolist() for e in edges(symbols, least_lcp(least, times))), strict=True):
        a, b = top(i), top(j)
        small, large = members.pop(a, None) or [a], members.pop(b, None) or [b]
        if len(small) > len(large):
            small, large, a, b = large, small, b, a
        root[a] = b
        if isinstance(large, list):
            if len(small) + len(large) > BLOCK:
                large = Positions(large)
        low, marks = None, list(small)
        for x, after in zip(marks, [*marks[1:], None], strict=True):
            p, s = _around(large, x) if isinstance(large, list) else large.around(x)
            if p is not None and (low is None or low < p):
                seed(p, x, shared)
            if s is not None and (after is None or s < after):
                seed(x, s, shared)
            low = x
        if isinstance(large, list):
            for x in marks:
                insort(large, x)
        else:
            for x in marks:
                large.add(x)
        members[b] = large
    out = np.array(found, np.int64).reshape(-1, 3)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _around(values: list[int], x: int) -> tuple[int | None, int | None]:
    at = bisect_right(values, x)
    return values[at - 1] if at else None, values[at] if at < len(values) else None


def periodic(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] | None = None, least: int = LEAST_WORDS, times: int = TIMES, rewrite=None) -> DataFrame:
    """``keep`` (the id by default), ``runs`` and ``collapsed`` of every row.

    Words are what stands between blanks (space and U+0009 to U+000D), numbered from 0. ``runs`` are (start, length, period) in order
    of start and period; ``collapsed`` are the words, joined by one space, without those that a run holds after its first period.
    ``rewrite`` may replace the words of a text: (id, list of UTF-8 words) to such a list. A null or empty text has no run and
    collapses to the empty text; repeated rows are judged alike; an empty table gives no rows; a kept column named like a result
    gives way to it. ``times`` is 2 or more.
    """
    if times < 2:
        raise ValueError("a run is at least twice as long as its period")
    keep = common.others(keep or (id_col,), "runs", "collapsed")
    docs = common.of_texts(docs).select(*keep, docs[id_col].alias("__id"), docs[text_col].alias("__text"))
    schema = docs.select(*keep).schema.add("runs", T.ArrayType(T.StructType([T.StructField(f.name, T.LongType()) for f in RUN]))).add("collapsed", "string")

    def run(batches):
        for batch in common.sliced(batches, "__text"):
            code = defaultdict(count(batch.num_rows).__next__)  # the numbers below close the texts
            texts, parts = [], []
            for k, (own, text) in enumerate(zip(batch.column("__id").to_pylist(), batch.column("__text").cast(pa.binary()).to_pylist(), strict=True)):
                words = (text or b"").split()
                words = rewrite(own, words) if rewrite else words
                texts.append(words)
                parts += [np.fromiter(map(code.__getitem__, words), np.int64, len(words)), np.array([k])]
            size = np.array([len(w) + 1 for w in texts])
            begin = np.cumsum(size) - size
            flat = np.concatenate(parts)
            closed = np.flatnonzero(flat < batch.num_rows)
            spread = flat + np.repeat(np.arange(len(size)), size) * (len(code) + batch.num_rows)  # words of different texts differ
            spread[closed] = flat[closed]
            found = runs(spread, least, times)
            doc = np.searchsorted(begin, found[:, 0], side="right") - 1
            gone = np.zeros(len(flat) + 1, np.int64)
            np.add.at(gone, found[:, 0] + found[:, 2], 1)
            np.add.at(gone, found[:, 0] + found[:, 1], -1)
            stay, hit = np.cumsum(gone) == 0, np.zeros(len(texts), bool)
            hit[doc] = True
            joined = [b" ".join(compress(w, stay[a : a + len(w)].tolist()) if h else w) for w, a, h in zip(texts, begin.tolist(), hit.tolist(), strict=True)]
            ends = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
            cells = pa.StructArray.from_arrays([pa.array(found[:, 0] - begin[doc]), pa.array(found[:, 1]), pa.array(found[:, 2])], fields=list(RUN))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.ListArray.from_arrays(pa.array(ends), cells), pa.array(joined, pa.binary()).cast(pa.string())], names=[*keep, "runs", "collapsed"])

    return docs.mapInArrow(run, schema)


def _planted(doc_id, words: list[bytes]) -> list[bytes]:
    """The contract's rewriting: every tenth document repeats a stretch from some word on."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    stretch = words[a : a + p]
    return words[:a] + (stretch * (-(-(n - a) // p)))[: n - a]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: number, longest and digests of the runs of every document. A null text has none, a null id is not rewritten; an empty table gives no rows."""
    found = periodic(common.table(spark, sf_dir, "documents"), rewrite=_planted)
    best = "array_min(transform(runs, r -> named_struct('o', -(r.length / r.period), 'start', r.start, 'period', r.period, 'length', r.length)))"
    lines = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')"
    found = found.selectExpr("doc_id", "cast(size(runs) as bigint) as n_runs", f"{best} as b", f"sha2({lines}, 256) as runs_sha256", "sha2(collapsed, 256) as collapsed_sha256")
    return found.select("doc_id", "n_runs", "b.start", "b.length", "b.period", F.expr("1000 * b.length div b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
