"""Trace files: one JSON array of events (or an object holding it), of any size, cut off or not.

Spark's own multi-line reader loses every event of a file that was cut off while being written. Here Spark reads the bytes (so
that any store works) and a scanner gives each complete element as text; parsing and all that follows is Spark's.
"""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import scalars as S
from spindrift.plans import rules

#: Elements longer than this are reported without their text.
MOST_ELEMENT = 8 << 20
_BLANK = " \t\r\n,"


class ElementScanner:
    """Gives the elements of the arrays of a JSON text that comes in chunks of any size.

    ``push`` and ``end`` return lists of (key, text): key is the name of the owning array in the outer object ("" for a bare array).
    Plain fields of the outer object are collected in ``fields``. A text that stops inside an element sets ``truncated``.
    """

    def __init__(self, most_element: int = MOST_ELEMENT):
        self.buffer, self.at, self.state, self.key, self.need = "", 0, "start", "", 0
        self.most, self.truncated, self.oversized, self.fields = most_element, False, 0, {}
        self.decode = json.JSONDecoder(strict=False).raw_decode

    def push(self, chunk: str) -> list[tuple[str, str]]:
        self.buffer += chunk
        return self._run() if len(self.buffer) - self.at >= self.need else []

    def end(self) -> list[tuple[str, str]]:
        out = self._run(last=True)
        self.truncated |= self.state not in ("done", "start") or bool(self.buffer[self.at :].strip() and self.state != "done")
        return out

    def _value(self, last: bool):
        """End of the value at the cursor, or None if it isn't complete yet."""
        b = self.buffer
        try:
            stop = self.decode(b, self.at)[1]
        except (ValueError, RecursionError):
            return None
        if b[self.at] not in '{["' and not last and (stop == len(b) or b[stop] not in ",]} \t\r\n"):
            return None  # a number or word may go on in the next chunk
        return stop

    def _run(self, last: bool = False) -> list[tuple[str, str]]:
        out: list[tuple[str, str]] = []
        self.need = 0
        while True:
            b = self.buffer
            while self.at < len(b) and b[self.at] in _BLANK:
                self.at += 1
            if self.at >= len(b):
                break
            c = b[self.at]
            if self.state == "start":
                if c not in "[{":
                    self.state = "done"
                    self.truncated = True
                    break
                self.state, self.at = ("array" if c == "[" else "object"), self.at + 1
                self.outer = self.state
            elif self.state == "array":
                if c == "]":
                    self.state, self.at = ("object" if self.outer == "object" else "done"), self.at + 1
                    continue
                stop = self._value(last)
                if stop is None:
                    self.need = 2 * (len(b) - self.at)
                    break
                if stop - self.at > self.most:
                    self.oversized += 1
                else:
                    out.append((self.key, b[self.at : stop]))
                self.at = stop
            elif self.state == "object":
                if c == "}":
                    self.state, self.at = "done", self.at + 1
                    continue
                stop = self._value(last)
                if c != '"' or stop is None:
                    break
                key, colon = json.loads(b[self.at : stop]), stop
                while colon < len(b) and b[colon] in " \t\r\n:":
                    colon += 1
                if colon >= len(b):
                    break
                if b[colon] == "[":
                    self.key, self.state, self.at = key, "array", colon + 1
                    continue
                self.at, back = colon, self.at
                stop = self._value(last)
                if stop is None:
                    self.at, self.need = back, 2 * (len(b) - back)
                    break
                self.fields[key], self.at = b[self.at : stop], stop
            else:
                break
            if self.at > 1 << 20:
                self.buffer, self.at = self.buffer[self.at :], 0
        return out


def scan_text(text: str, keys: set[str] | None = None) -> tuple[list[tuple[str, str]], ElementScanner]:
    """All elements of one text; with ``keys``, those of arrays of these names or without a name."""
    scanner = ElementScanner()
    found = scanner.push(text) + scanner.end()
    return [x for x in found if keys is None or not x[0] or x[0] in keys], scanner


def read_elements(spark: SparkSession, path: str | None = None, glob: str = "*.json", chunk: int = 4 << 20, files: DataFrame | None = None) -> DataFrame:
    """(path, seq, key, element, truncated) of all files below ``path``, or of ``files`` (path, content).

    One row without element tells of a cut-off or oversized file.
    """
    if files is None:
        files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    files = files.select("path", "content")
    names = ["path", "seq", "key", "element", "truncated"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                scanner, seq, raw = ElementScanner(), 0, content.as_buffer()
                decoder = codecs.getincrementaldecoder("utf-8-sig")("replace")
                for at in range(0, max(1, raw.size), chunk):
                    piece = decoder.decode(raw.slice(at, min(chunk, raw.size - at)).to_pybytes() if raw.size else b"", at + chunk >= raw.size)
                    found = scanner.push(piece)
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array([where] * len(found)), pa.array(range(seq, seq + len(found)), pa.int64()), pa.array([k for k, _ in found]), pa.array([t for _, t in found]), pa.array([False] * len(found))], names=names)
                        seq += len(found)
                found = scanner.end()
                rows = [(where, seq + i, k, t, False) for i, (k, t) in enumerate(found)]
                if scanner.truncated or scanner.oversized:
                    rows.append((where, seq + len(found), None, None, True))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_()), strict=True)], names=names)

    return files.mapInArrow(run, "path string, seq long, key string, element string, truncated boolean")


EVENT = "ph string, name string, pid string, tid string, ts string, dur string, cat string, args map<string, string>"


def parsed(elements: DataFrame) -> DataFrame:
    """(path, seq, ph, name, pid, tid, ts, dur, cat, args) of elements shaped like events; argument keys in lower case, one level flat."""
    e = elements.where("element is not null and (key = '' or key = 'traceEvents')").withColumn("e", F.from_json("element", EVENT)).select("path", "seq", "e.*")
    e = e.where("ph is not null or (ts is not null and (name is not null or pid is not null))")
    e = e.withColumn("nested", F.expr("from_json(get(transform(filter(map_entries(coalesce(args, map())), x -> lower(x.key) = 'args'), x -> x.value), 0), 'map<string, string>')"))
    flat = "map_from_entries(array_distinct(concat(transform(map_entries(coalesce(args, map())), x -> struct(lower(x.key), x.value)), transform(map_entries(coalesce(nested, map())), x -> struct(concat('args.', lower(x.key)), x.value)))))"
    return e.withColumn("args", F.expr(flat)).drop("nested")


def picked(field: str):
    """First argument that a canonical field goes by."""
    return F.coalesce(*(F.col("args")[k] for k in rules.ARG_KEYS[field]))


def trace_events(elements: DataFrame) -> DataFrame:
    """Canonical events (idx, name, ts_us, dur_us, device, lane, stream, rank, ...) of complete, instant and paired begin/end elements.

    The side of an event: its process's label, then device or stream arguments, then its category; else host. ``ts_us`` is a decimal:
    a double can't hold microseconds since 1970 with three decimals.
    """
    e = parsed(elements)
    labels = e.where("ph = 'M' and name in ('process_name', 'process_labels')").groupBy("path", "pid").agg(F.max(F.coalesce(F.col("args")["name"], F.col("args")["labels"])).alias("label")).selectExpr("path as __f", "pid as __p", "label")
    number = lambda c: F.col(c).try_cast("decimal(20,3)")
    timed = e.where("ph is null or ph in ('X', 'B', 'E', 'i')").withColumn("ts_us", number("ts")).withColumn("dur_us", F.col("dur").try_cast("double")).where("ts_us is not null")
    by = "over (partition by path, pid, tid, name order by seq)"
    marks = timed.where("ph in ('B', 'E')").selectExpr("*", f"lag(ph) {by} as p", f"lag(ts_us) {by} as b", f"lag(args) {by} as ba").where("ph = 'E' and p = 'B'")
    pairs = marks.withColumn("dur_us", (F.col("ts_us") - F.col("b")).cast("double")).withColumn("ts_us", F.col("b")).withColumn("args", F.expr("if(size(args) = 0, ba, args)")).drop("p", "b", "ba")
    own = timed.where("ph is null or ph not in ('B', 'E')").unionByName(pairs)
    own = own.join(labels, (own["path"] == labels["__f"]) & own["pid"].eqNullSafe(labels["__p"]), "left").drop("__f", "__p")
    device = F.coalesce(S.side_of_label("label"), F.when(picked("device_id").isNotNull() | picked("stream").isNotNull(), "device"), F.when(F.lower("cat").rlike("kernel|hccl|npu|device"), "device"), F.lit("host"))
    own = own.withColumn("device", device).withColumn("stream", picked("stream")).withColumn("rank", F.coalesce(picked("rank"), S.rank_from_name("path")))
    fields = {k: picked(k) for k in ("op_type", "task_type", "core_type", "shapes_in", "shapes_out", "call_stack", "message")} | {k: picked(k).try_cast("double") for k in ("flops", "wait_us", "token_count")}
    own = own.withColumns(fields).withColumn("dur_us", F.coalesce("dur_us", F.lit(0.0))).withColumn("lane", F.concat_ws(":", "device", F.coalesce("stream", "tid", F.lit("0"))))
    c = S.classify("name", "device", "op_type", "task_type", "core_type", "cat")
    return own.withColumn("c", c).select("path", F.col("seq").alias("idx"), "name", S.normalize_name("name").alias("normalized_name"), "ts_us", "dur_us", "device", "lane", "pid", "tid", "label", "stream", "rank", "cat", *fields, "args", F.col("c.category").alias("category"), "c.subtype", "c.role")


def timeline(events: DataFrame) -> DataFrame:
    """Events with whole-microsecond times from the first event's start (idx, ts, te, dur, device, category, ... as the operators want them)."""
    least = events.agg(F.min("ts_us").alias("__o"))
    t = events.join(F.broadcast(least)).withColumn("ts", F.expr("cast(round((ts_us - __o) * 1000) as bigint) div 1000")).withColumn("dur", F.expr("cast(round(dur_us) as bigint)"))
    return t.withColumn("te", F.expr("ts + dur")).withColumn("raw_name", F.col("name")).withColumn("name", F.col("normalized_name")).drop("__o")
