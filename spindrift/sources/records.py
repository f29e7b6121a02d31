"""Binary records, archives and side-car JSON: Spark reads the bytes, small decoders run on them in Arrow batches."""

from __future__ import annotations

import io
import json
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_DEPTH, MOST_FIELDS = 12, 20_000
#: Limits of one archive: members, and bytes of a member.
MOST_MEMBERS, MOST_BYTES = 256, 512 << 20


def varint(data: bytes, at: int) -> tuple[int, int]:
    """(value, next place); ValueError where there is none."""
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("varint")
        b = data[at]
        value, at = value | (b & 0x7F) << shift, at + 1
        if b < 0x80:
            return value, at
        shift += 7


def printable(data: bytes) -> bool:
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return False
    return all(c.isprintable() or c in "\t\r\n" for c in text)


def decode_message(data: bytes, depth: int = 0) -> list[tuple[int, str, object]]:
    """Fields (number, kind, value) of a wire-format message; nested ones where bytes aren't text and are used up exactly."""
    out, at = [], 0
    while at < len(data) and len(out) < MOST_FIELDS:
        key, at = varint(data, at)
        number, wire = key >> 3, key & 7
        if number == 0:
            raise ValueError("field 0")
        if wire == 0:
            value, at = varint(data, at)
            out.append((number, "varint", value))
        elif wire in (1, 5):
            n = 8 if wire == 1 else 4
            if at + n > len(data):
                raise ValueError("cut off")
            out.append((number, "double" if wire == 1 else "float", struct.unpack_from("<d" if wire == 1 else "<f", data, at)[0]))
            at += n
        elif wire == 2:
            n, at = varint(data, at)
            if at + n > len(data):
                raise ValueError("cut off")
            part, at = data[at : at + n], at + n
            if part and printable(part):
                out.append((number, "text", part.decode()))
                continue
            try:
                if not part or depth >= MOST_DEPTH:
                    raise ValueError
                out.append((number, "message", decode_message(part, depth + 1)))
            except ValueError:
                out.append((number, "bytes", part))
        else:
            raise ValueError("wire type")
    return out


def split_records(data: bytes) -> list[bytes]:
    """Length-delimited records; [] unless they use up all the bytes."""
    out, at = [], 0
    try:
        while at < len(data):
            n, at = varint(data, at)
            if n == 0 or at + n > len(data):
                return []
            out.append(data[at : at + n])
            at += n
    except ValueError:
        return []
    return out


def _leaves(fields, out):
    for number, kind, value in fields:
        if kind == "message":
            _leaves(value, out)
        else:
            out.append((number, kind, value))
    return out


def event_of(fields, names: dict[str, int] | None = None) -> dict | None:
    """Event of a message: by field numbers (name, start, dur or end), else by likeness; None if it has no name and start."""
    if names:
        own = {n: v for n, _, v in fields}
        name, start = own.get(names["name"]), own.get(names["start"])
        dur = own.get(names["dur"]) if "dur" in names else (own[names["end"]] - start if start is not None and names.get("end") in own else None)
        return None if name is None or start is None else {"name": str(name), "start_us": float(start), "dur_us": float(dur or 0), "confidence": "mapped"}
    leaves = _leaves(fields, [])
    name = next((v for _, k, v in leaves if k == "text" and any(c.isalpha() for c in v)), None)
    numbers = [float(v) for _, k, v in leaves if k in ("varint", "double", "float")]
    place = next((i for i, v in enumerate(numbers) if v >= 1e6), None)
    if name is None or place is None:
        return None
    dur, start = 0.0, numbers[place]
    for v in numbers[place + 1 :]:
        if 0 < v <= 6e7:
            dur = v
            break
        if v > start:
            dur = v - start
            break
    return {"name": name, "start_us": start, "dur_us": dur, "confidence": "low"}


def files(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """(path, length, content, ...) of all files below a path or several."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


#: Extensions of the files of a capture, and of archives and databases among them.
EXTENSIONS = r"(?i)\.(?:json|csv|txt|log|proto|pb|bin|db|zip|tar|tgz|gz)$"


def chosen(found: DataFrame, named: list[str], most: int | None = None, most_bytes: int | None = None) -> tuple[DataFrame, list[str]]:
    """The files to read, and what was left out: other extensions (unless a file is named itself), larger than ``most_bytes``, beyond the first ``most`` by path."""
    own = [p.removeprefix("file://").rstrip("/") for p in named]
    known = F.col("path").rlike(EXTENSIONS) | F.regexp_replace("path", "^[a-z]+:/*", "/").isin(own)
    fits = F.lit(True) if most_bytes is None else F.col("length") <= most_bytes
    counts = found.select("path", "length").agg(F.count_if(~known).alias("other"), F.count_if(known & ~fits).alias("large"), F.count_if(known & fits).alias("rest")).first()
    out = found.where(known & fits)
    notes = [f"{n} files left out: {why}" for n, why in ((counts["other"], "no known extension"), (counts["large"], f"over {most_bytes} bytes")) if n]
    if most is not None and counts["rest"] > most:
        notes.append(f"{counts['rest'] - most} files left out: over {most} files")
        out = out.join(F.broadcast(out.select("path").orderBy("path").limit(most)), "path", "left_semi")
    return out, notes


#: Characters of a file that tell what it is, and bytes of a file up to which it is read as one row for them.
HEAD, ONE_ROW = 262_144, 64 << 20


def heads(spark: SparkSession, found: DataFrame) -> DataFrame:
    """(path, length, name, head) of files (path, length, content): the beginning of each, of large ones without reading them whole."""
    name = F.substring_index("path", "/", -1).alias("name")
    few = found.where(F.col("length") <= ONE_ROW).select("path", "length", name, F.substring("content", 1, HEAD).cast("string").alias("head"))
    large = {r["path"]: r["length"] for r in found.where(F.col("length") > ONE_ROW).select("path", "length").collect()}  # a row for each large file
    if not large:
        return few

    def run(batches):
        own, held = None, ""

        def told():
            return pa.RecordBatch.from_arrays([pa.array([own]), pa.array([large.get(own, 0)], pa.int64()), pa.array([own.rsplit("/", 1)[-1]]), pa.array([held[:HEAD]])], names=["path", "length", "name", "head"])

        for batch in batches:
            for path, value in zip(batch.column("path").to_pylist(), batch.column("value"), strict=True):
                if path != own:
                    if own:
                        yield told()
                    own, held = path, ""
                if len(held) < HEAD:
                    held += value.as_buffer().to_pybytes()[: HEAD * 4].decode("utf-8", "replace") + "}"
        if own:
            yield told()

    rows = spark.read.option("lineSep", "}").text(list(large)).where("_metadata.file_block_start = 0").selectExpr("_metadata.file_path as path", "cast(value as binary) as value")
    return few.unionByName(rows.mapInArrow(run, "path string, length long, name string, head string"))


def read_records(spark: SparkSession, path: str | None = None, names: dict[str, int] | None = None, glob: str = "*.{pb,proto,bin}", files: DataFrame | None = None) -> DataFrame:
    """(path, idx, name, start_us, dur_us, confidence) of all record files below ``path``, or of ``files`` (path, content).

    Files that aren't records give no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for where, data in zip(part["path"], part["content"], strict=True):
                rows = []
                for i, record in enumerate(split_records(bytes(data)) or [bytes(data)]):
                    try:
                        event = event_of(decode_message(record), names)
                    except ValueError:
                        continue
                    if event:
                        rows.append({"path": where, "idx": i} | event)
                if rows:
                    yield pd.DataFrame(rows)

    return _chosen(spark, path, glob, files).select("path", "content").mapInPandas(run, "path string, idx long, name string, start_us double, dur_us double, confidence string")


def inflated(name: str, data: bytes) -> bytes:
    """All members of a gzip, one after the other; ValueError if it is cut off, has other bytes at its end or is over ``MOST_BYTES``."""
    out, size = [], 0
    while data:
        if data[:2] != b"\x1f\x8b":
            raise ValueError(f"{name}: bytes after the gzip members")
        one = zlib.decompressobj(31)
        out.append(one.decompress(data, MOST_BYTES - size + 1))
        size += len(out[-1])
        if size > MOST_BYTES:
            raise ValueError(f"{name}: over {MOST_BYTES} bytes when inflated")
        if not one.eof:
            raise ValueError(f"{name}: the gzip is cut off")
        data = one.unused_data.lstrip(b"\0")
    return b"".join(out)


def _within(name: str, n: int, sizes: Iterator[int]) -> None:
    """ValueError if an archive of ``n`` members is over a limit."""
    if n > MOST_MEMBERS or max(sizes, default=0) > MOST_BYTES:
        raise ValueError(f"{name}: over {MOST_MEMBERS} members or a member over {MOST_BYTES} bytes")


def members(name: str, data: bytes) -> Iterator[tuple[str, bytes]]:
    """Files in a zip, tar, tar.gz or gz; anything else is itself. Limits count for each archive; ValueError where one is exceeded, so that no part is missing unseen."""
    if data[:4] == b"PK\x03\x04" or data[:4] == b"PK\x05\x06":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            infos = [i for i in z.infolist() if not i.is_dir()]
            _within(name, len(infos), (i.file_size for i in infos))
            for info in infos:
                if info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                    raise ValueError(f"{name}: {info.filename} has another compression")
                yield info.filename, z.read(info)
        return
    if data[:2] == b"\x1f\x8b":
        data, name = inflated(name, data), name.removesuffix(".gz").replace(".tgz", ".tar")
    if len(data) > 262 and data[257:262] == b"ustar":
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            infos = [i for i in t if i.isfile()]
            _within(name, len(infos), (i.size for i in infos))
            for info in infos:
                yield info.name, t.extractfile(info).read()
        return
    yield name, data


def _chosen(spark: SparkSession, path: str | None, glob: str, chosen: DataFrame | None) -> DataFrame:
    return files(spark, path, glob) if chosen is None else chosen


def expand_archives(found: DataFrame) -> DataFrame:
    """(archive, name, content, length): all of ``found`` (path, content), those in archives one by one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for where, data in zip(part["path"], part["content"], strict=True):
                for name, content in members(where.rsplit("/", 1)[-1], bytes(data)):
                    yield pd.DataFrame([{"archive": where, "name": name, "content": content, "length": len(content)}])

    return found.select("path", "content").mapInPandas(run, "archive string, name string, content binary, length long")


def aux_kind(name: str, data) -> str:
    low = name.lower()
    if isinstance(data, list) and any("mstx" in json.dumps(x) for x in data):
        return "mstx"
    for kind, words in (("mstx", ("mstx",)), ("communication_matrix", ("communication_matrix",)), ("communication", ("communication",)), ("memory", ("memory",)), ("profiler_info", ("profiler_info", "profiler_metadata"))):
        if any(w in low for w in words):
            return kind
    return "metadata" if isinstance(data, dict) else "json-generic"


def side_markers(aux: DataFrame) -> DataFrame:
    """(ts, dur, text) of the entries of marker side-cars (kind ``mstx``): time, length and name or message with domain."""
    entry = "array<struct<name: string, message: string, domain: string, ts: string, start: string, timestamp: string, dur: string>>"
    rows = aux.where("kind = 'mstx'").selectExpr(f"inline(from_json(body, '{entry}'))")
    out = rows.selectExpr("try_cast(coalesce(ts, start, timestamp) as decimal(20,3)) as ts", "coalesce(try_cast(dur as double), 0) as dur", "concat_ws(' ', coalesce(name, message), domain) as text")
    return out.where("ts is not null")


def read_aux(spark: SparkSession, path: str | None = None, glob: str = "*.json", files: DataFrame | None = None) -> DataFrame:
    """(name, kind, entries, body): side-car files; text that isn't JSON has the kind ``json-invalid``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = []
            for where, data in zip(part["path"], part["content"], strict=True):
                name, text = where.rsplit("/", 1)[-1], bytes(data).decode("utf-8-sig", "replace")
                try:
                    body = json.loads(text)
                    rows.append({"name": name, "kind": aux_kind(name, body), "entries": len(body) if isinstance(body, (dict, list)) else 1, "body": text})
                except ValueError:
                    rows.append({"name": name, "kind": "json-invalid", "entries": 0, "body": None})
            yield pd.DataFrame(rows)

    return _chosen(spark, path, glob, files).select("path", "content").mapInPandas(run, "name string, kind string, entries long, body string")


def write_zip(entries: list[tuple[str, bytes]]) -> bytes:
    """A zip of stored entries with their checksums."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in entries:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


def lineage(files: DataFrame, events: DataFrame) -> DataFrame:
    """(path, length, events): every file beside the number of events that came from it."""
    n = events.groupBy(F.col("path").alias("__p")).agg(F.count("*").alias("events"))
    return files.join(n, files["path"] == n["__p"], "left").select("path", "length", F.coalesce("events", F.lit(0)).alias("events"))
