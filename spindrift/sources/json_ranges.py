"""JSON arrays of any size, read in the byte ranges that Spark plans.

Whether a byte is part of a string, and how deep it stands, depends on all bytes before it. So a first pass computes, for each range and
for each of the four states in which it may begin (in a string or not, behind a backslash or not), the state in which it ends and by
how much the depth changes; one row a range. Composed in order they give every range its true beginning, and a second pass cuts all
ranges into elements at once. What a border divides is put together from the pieces: two a range at most.

Ranges are rows of Spark's text reader with ``}`` as the end of a line, so any store works that Spark reads, a file is as large as it
likes and no Python code opens it. An outer object gives the elements of all its arrays with the array's name; nested objects beside
them are passed over. A file that stops short keeps its complete elements and one row tells of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.tables import kept

#: States: in a string (1), the next byte is behind a backslash (2), both (3).
STRING, ESCAPED = 1, 2
STEP = np.zeros(256, np.int64)
STEP[[91, 123]], STEP[[93, 125]] = 1, -1
MARK = STEP != 0
MARK[44] = True
BLANKS = b" \t\r\n"
PIECES = "path string, start long, at long, kind string, region long, data binary"


def marks(data: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """(positions of brackets, braces and commas outside strings, state behind the bytes) of bytes that begin in ``state``."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), state
    slash, escaped = data == 92, np.zeros(n + 1, bool)
    if slash.any():
        edge = np.flatnonzero(np.diff(np.r_[False, slash, False].astype(np.int8)))
        first, last = edge[::2], edge[1::2]
        length = last - first - (first == 0) * (state & ESCAPED > 0)
        escaped[last[length % 2 == 1]] = True
    if state & ESCAPED and not slash[0]:
        escaped[0] = True
    quote = (data == 34) & ~escaped[:n]
    inside = np.cumsum(quote) + (state & STRING)
    free = (inside - quote) % 2 == 0
    return np.flatnonzero(free & MARK[data]), int(inside[-1] % 2) | ESCAPED * int(escaped[n])


class Summary:
    """What a range does to each state in which it may begin: the state behind it and the change of depth."""

    def __init__(self):
        self.states, self.depths, self.size, self.first = [0, 1, 2, 3], [0, 0, 0, 0], 0, None

    def push(self, data: bytes) -> None:
        if self.first is None and (text := data.lstrip(BLANKS)):
            self.first = text[:1]
        self.size += len(data)
        raw = np.frombuffer(data, np.uint8)
        done = {}
        for s in set(self.states):
            at, after = marks(raw, s)
            done[s] = after, int(STEP[raw[at]].sum())
        self.depths = [d + done[s][1] for s, d in zip(self.states, self.depths, strict=True)]
        self.states = [done[s][0] for s in self.states]


class Cutter:
    """Cuts a range that begins in a known state into pieces (at, kind, region, bytes).

    ``whole``: an element; ``head``, ``middle``, ``tail``: of one that a border divides; ``outer``: text of the outer object, with a
    number between two U+0001 for each array; ``split``: the array (or -1 for an object) that was opened last; ``end``: here the
    outermost value ends.
    """

    def __init__(self, state: int, depth: int, outer: bytes, start: int):
        self.state, self.depth, self.level, self.start = state, depth, 1 if outer == b"[" else 2, start
        self.region, self.last, self.count, self.done = None, None, 0, outer not in (b"[", b"{")
        self.began, self.held, self.text = depth < self.level, [], []

    def _next(self) -> int:
        self.count += 1
        return self.start + self.count - 1

    def _element(self, out: list) -> None:
        data = b"".join(self.held)
        self.held = []
        if not self.began:
            out.append((self._next(), "head", self.region, data))
        elif self.region != -1 and (data := data.strip(BLANKS)):
            out.append((self._next(), "whole", self.region, data))
        self.began = True

    def push(self, data: bytes) -> list:
        out, at = [], 0
        if self.done:
            return out
        raw = np.frombuffer(data, np.uint8)
        where, self.state = marks(raw, self.state)
        step = STEP[raw[where]]
        after = self.depth + np.cumsum(step)
        near = ((step == 0) & (after == self.level)) | ((step > 0) & (after <= self.level)) | ((step < 0) & (after < self.level))
        for p, s, d in zip(where[near].tolist(), step[near].tolist(), after[near].tolist(), strict=True):
            if s == 0:
                self.held.append(data[at:p])
                self._element(out)
                at = p + 1
            elif s > 0 and d == self.level:
                self.text.append(data[at:p])
                self.began, at = True, p + 1
                self.region = self.last = self._next() if raw[p] == 91 else -1
                self.text.append(b"\x01%d\x01" % self.region if self.region >= 0 else b"{}")
            elif s < 0 and d == self.level - 1:
                self.held.append(data[at:p])
                self._element(out)
                at = p + 1
            if s < 0 and d <= 0:
                out.append((self._next(), "end", None, None))
                self.done = True
                return out
        self.depth = int(after[-1]) if len(after) else self.depth
        (self.held if self.depth >= self.level else self.text).append(data[at:])
        return out

    def end(self) -> list:
        out = []
        if not self.done and self.depth >= self.level:
            out.append((self._next(), "tail" if self.began else "middle", self.region, b"".join(self.held)))
        if self.level == 2 and any(self.text):
            out.append((self._next(), "outer", None, b"".join(self.text)))
        return [*out, (self._next(), "split", self.last, None)]


def _chunks(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, start, size, data): what stands between braces, in order inside each range."""
    rows = spark.read.option("lineSep", "}").text(paths)
    return rows.selectExpr("_metadata.file_path as path", "_metadata.file_block_start as start", "_metadata.file_size as size", "cast(value as binary) as data")


def _ranges(batches):
    """(path, start, size, bytes) of successive parts of ranges; each closes its last row with the brace that ends a line."""
    for batch in batches:
        if not batch.num_rows:
            continue
        path, start, size = (batch.column(c) for c in ("path", "start", "size"))
        own = start.to_numpy()
        path = path.dictionary_encode()
        code = path.indices.to_numpy()
        cuts = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (code[1:] != code[:-1]), True])
        data = batch.column("data").to_pylist()
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield path[a].as_py(), int(own[a]), size[a].as_py(), b"}".join(data[a:b]) + b"}"


def _summed(batches):
    own, held = None, None
    names = ["path", "start", "size", "read", "first", "states", "depths"]

    def told():
        return pa.RecordBatch.from_arrays([pa.array([own[0]]), pa.array([own[1]]), pa.array([own[2]]), pa.array([held.size]), pa.array([held.first], pa.binary()), pa.array([held.states], pa.list_(pa.int32())), pa.array([held.depths], pa.list_(pa.int64()))], names=names)

    for path, start, size, data in _ranges(batches):
        if own != (path, start, size):
            if own:
                yield told()
            own, held = (path, start, size), Summary()
        held.push(data)
    if own:
        yield told()


def _cut(batches, begins: dict):
    own, held = None, None
    names = ["path", "start", "at", "kind", "region", "data"]

    def told(found):
        at, kind, region, data = (list(x) for x in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array([own[0]] * len(found)), pa.array([own[1]] * len(found)), pa.array(at, pa.int64()), pa.array(kind), pa.array(region, pa.int64()), pa.array(data, pa.binary())], names=names)

    for path, start, _, data in _ranges(batches):
        if own != (path, start):
            if own:
                yield told(held.end())
            own, held = (path, start), Cutter(*begins[path, start], start)
        found = held.push(data)
        if found:
            yield told(found)
    if own:
        yield told(held.end())


def begins(ranges: list) -> tuple[dict, dict]:
    """({(path, start): (state, depth, outer)}, {path: (size, cut off)}) from the summaries of all ranges (path, start, size, read, first, states, depths)."""
    found, files = {}, {}
    by: dict = {}
    for r in sorted(ranges, key=lambda r: (r["path"], r["start"])):
        by.setdefault(r["path"], []).append(r)
    for path, rows in by.items():
        state = depth = 0
        outer = next((bytes(r["first"]) for r in rows if r["first"] is not None), b"")
        for r in rows:
            found[path, r["start"]] = (state, depth, outer)
            state, depth = r["states"][state], depth + r["depths"][state]
        if sum(r["read"] for r in rows) > rows[-1]["size"] and rows[-1]["size"]:  # the last line had no brace at its end
            depth += not state & STRING
        files[path] = rows[-1]["size"], depth > 0 or outer not in (b"[", b"{")
    return found, files


def read_elements(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, seq, key, element, truncated) of all files in ``paths``: complete elements with the name of their array ("" for a bare one).

    ``seq`` rises through a file. One row without element tells of a file that stops short or isn't JSON. The driver gets a row for each
    range (by default 128 MB). Empty files have no rows.
    """
    chunks = _chunks(spark, paths)
    ranges = chunks.mapInArrow(_summed, "path string, start long, size long, read long, first binary, states array<int>, depths array<long>").collect()
    known, files = begins(ranges)
    pieces = kept(chunks.mapInArrow(lambda it: _cut(it, known), PIECES), "json-pieces")
    splits = pieces.where("kind = 'split'").selectExpr("path as p", "start as s", "last_value(region) ignore nulls over (partition by path order by start rows between unbounded preceding and 1 preceding) as inherited")
    border = pieces.where("kind in ('head', 'middle', 'tail')").selectExpr("*", "last_value(case when kind = 'tail' then at end) ignore nulls over (partition by path order by start, at rows unbounded preceding) as own")  # two a range
    joined = border.groupBy("path", "own").agg(F.min("start").alias("start"), F.max(F.expr("case when kind = 'tail' then region end")).alias("region"), F.max(F.expr("kind = 'head'")).alias("closed"), F.sort_array(F.collect_list(F.struct("start", "at", "data"))).alias("parts"))
    joined = joined.where("closed and own is not null").selectExpr("path", "start", "own as at", "region", "aggregate(parts, cast('' as binary), (x, y) -> concat(x, y.data)) as data")
    every = pieces.where("kind = 'whole'").select("path", "start", "at", "region", "data").unionByName(joined)
    every = every.join(splits, (every["path"] == splits["p"]) & (every["start"] == splits["s"])).withColumn("region", F.expr("coalesce(region, inherited)")).drop("p", "s", "inherited")
    outer = pieces.where("kind = 'outer'").groupBy("path").agg(F.sort_array(F.collect_list(F.struct("start", "at", "data"))).alias("parts")).selectExpr("path as p", "cast(aggregate(parts, cast('' as binary), (x, y) -> concat(x, y.data)) as string) as text")
    named = '"((?:[^"\\\\\\\\]|\\\\\\\\.)*)"\\\\s*:\\\\s*\\u0001(\\\\d+)\\u0001'
    keys = outer.selectExpr("p", f"inline(arrays_zip(regexp_extract_all(text, '{named}', 1), regexp_extract_all(text, '{named}', 2))) as (k, r)").selectExpr("p", "cast(r as bigint) as r", "from_json(concat('[\"', k, '\"]'), 'array<string>')[0] as key")
    bare = spark.createDataFrame([(p, outer == b"[", files[p][0], files[p][1]) for (p, s), (_, _, outer) in known.items() if s == 0] or [], "f string, bare boolean, size long, cut boolean")
    ends = pieces.where("kind = 'end'").groupBy("path").agg(F.min("at").alias("stop")).withColumnRenamed("path", "e")
    every = every.join(F.broadcast(bare), every["path"] == bare["f"]).join(ends, every["path"] == ends["e"], "left").where("stop is null or at < stop")
    every = every.join(keys, (every["path"] == keys["p"]) & (every["region"] == keys["r"]), "left").where("bare or key is not null")
    out = every.selectExpr("path", "at as seq", "if(bare, '', key) as key", "trim(BOTH ' \\t\\r\\n' FROM cast(data as string)) as element", "false as truncated").where("element <> ''")
    return out.unionByName(bare.where("cut").selectExpr("f as path", "size as seq", "cast(null as string) as key", "cast(null as string) as element", "true as truncated"))
