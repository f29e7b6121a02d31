"""Profiling tables in CSV: header spellings, units, metric columns and leftovers become canonical rows.

Columns are resolved once, on the driver, from the header line; each row is then a plain projection.
"""

from __future__ import annotations

import csv
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import scalars as S
from spindrift.plans import rules


def delimiter(line: str) -> str:
    """The most frequent of comma, tab and semicolon outside quotes."""
    bare = re.sub(r'"[^"]*"', "", line)
    return max(",\t;", key=lambda c: (bare.count(c), -",\t;".index(c)))


def header_key(cell: str) -> str:
    """How header cells are compared."""
    return re.sub(r"[\s_]+", "", cell.replace("﻿", "").strip().lower())


def unit_of(cell: str) -> str:
    """Unit that a header cell names."""
    found = re.search(r"\(\s*(ms|milliseconds?|ns|nanoseconds?|s|sec|seconds?|us|µs)\s*\)", cell.lower())
    unit = found[1] if found else "us"
    return "ms" if unit[0] == "m" else "ns" if unit[0] == "n" else "s" if unit[0] == "s" else "us"


def resolved(header: list[str]) -> dict[str, int]:
    """Column of each canonical field: the first of its spellings that exists."""
    at = {}
    for i, cell in enumerate(header):
        at.setdefault(header_key(cell), i)
    return {f: at[k] for f, names in rules.HEADERS.items() if (k := next((header_key(n) for n in names if header_key(n) in at), None)) is not None}


def metric_of(cell: str) -> str | None:
    """Hardware metric that a header cell stands for; time columns are none."""
    if re.search(r"\((?:us|ms|ns|s)\)", cell.lower()):
        return None
    return next((m for m, p in rules.METRIC_COLUMNS if re.search(p, cell.strip().lower())), None)


#: How cells are read.
CSV = {"quote": '"', "escape": '"', "comment": "#", "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True}


def encoding_of(head: bytes) -> str:
    """UTF-8, or GBK where UTF-8 gives over 0.2 % replacement characters and GBK fewer."""
    bad = head.decode("utf-8", "replace").count("�")
    return "GBK" if bad > 0.002 * max(1, len(head)) and head.decode("gbk", "replace").count("�") < bad else "UTF-8"


def _looked_at(files: DataFrame) -> tuple[str, str]:
    """(encoding, header line) of the one file of ``files`` (content): all its bytes count for the encoding."""

    def run(batches):
        for batch in batches:
            for content in batch.column("content").to_pylist():
                encoding = encoding_of(content)
                line = next((x for x in content[: 1 << 20].decode(encoding, "replace").splitlines() if x.strip() and not x.startswith("#")), "")
                yield pa.RecordBatch.from_arrays([pa.array([encoding]), pa.array([line])], names=["encoding", "line"])

    found = files.select("content").mapInArrow(run, "encoding string, line string").first()
    return (found["encoding"], found["line"].lstrip("\ufeff")) if found else ("UTF-8", "")


def read_table(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Canonical rows of one CSV file: kind, the fields that it has, ``utilization`` and ``extra`` maps, ``is_step_row``."""
    encoding, line = _looked_at(spark.read.format("binaryFile").load(path))
    raw = spark.read.csv(path, sep=delimiter(line), header=True, encoding=encoding, enforceSchema=False, mode="PERMISSIVE", **CSV)
    header = raw.columns
    raw = raw.toDF(*(f"c{i}" for i in range(len(header))))
    return canonical(raw, header, kind or _kind(path))


def read_member(files: DataFrame, path: str, kind: str | None = None) -> DataFrame:
    """``read_table`` of a file that stands in a row of ``files`` (content), such as a member of an archive."""
    encoding, line = _looked_at(files)
    header = next(csv.reader([line], delimiter=delimiter(line), skipinitialspace=True), [])
    whole = F.col("content").cast("string") if encoding == "UTF-8" else F.decode("content", encoding)  # a cast lets stray bytes pass
    text = files.select(F.explode(F.split(whole, "\r?\n")).alias("line")).where(F.trim("line") != "").where(~F.col("line").startswith("#"))
    rows = text.where(F.regexp_replace("line", "^\ufeff", "") != line)
    names = ", ".join(f"c{i} string" for i in range(len(header)))
    options = {"sep": delimiter(line), "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    return canonical(rows.select(F.from_csv("line", names, options).alias("r")).select("r.*"), [c.strip() for c in header], kind or _kind(path))


def _kind(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return next((k for k, p in rules.TABLE_KINDS if re.search(p, name, re.I)), "generic")


def canonical(raw: DataFrame, header: list[str], kind: str) -> DataFrame:
    """Canonical rows of text cells ``c0, c1, ...`` under a header; rows with neither name, type nor step go."""
    index = resolved(header)
    columns = {}
    for field, i in index.items():
        cell = f"c{i}"
        if field in rules.TEXT_FIELDS:
            columns[field] = S.placeholder_to_null(cell)
        elif field.endswith("_us") or field in rules.STEP_FIELDS:
            columns[field] = S.to_us(S.number(cell), F.lit(unit_of(header[i])))
        else:
            columns[field] = S.number(cell)
    used = set(index.values())
    metrics = {i: m for i, h in enumerate(header) if i not in used and (m := metric_of(h))}
    rest = [i for i in range(len(header)) if i not in used and i not in metrics]
    pack = lambda pairs, kind_: F.map_filter(F.create_map(*[x for p in pairs for x in p]), lambda _, v: v.isNotNull()) if pairs else F.create_map().cast(kind_)
    out = raw.select(
        F.lit(kind).alias("kind"), *(v.alias(k) for k, v in columns.items()), pack([(F.lit(m), S.ratio(S.number(f"c{i}"))) for m, i in {m: i for i, m in metrics.items()}.items()], "map<string,double>").alias("utilization"),
        pack([(F.lit(f"col{i}"), S.placeholder_to_null(f"c{i}")) for i in rest], "map<string,string>").alias("extra"),
    )
    for field in ("name", "op_type", "step", "count", "total_us", "dur_us"):
        if field not in columns:
            out = out.withColumn(field, F.lit(None).cast("string" if field in rules.TEXT_FIELDS else "double"))
    step = any(f in columns for f in ("step_computing", "step_comm", "step_free"))
    name = F.coalesce("name", "op_type", F.when(F.col("step").isNotNull(), F.concat(F.lit("Step "), F.col("step").cast("long").cast("string"))))
    out = out.withColumn("name", name).withColumn("count", F.coalesce("count", F.when(F.col("dur_us").isNotNull(), F.lit(1.0)))).withColumn("total_us", F.coalesce("total_us", "dur_us")).withColumn("is_step_row", F.lit(step))
    if step:
        out = _step_units(out, [c for c in rules.STEP_FIELDS if c in columns])
    return out.where("name is not null")


def _step_units(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Step tables in milliseconds without saying so: all totals below 2000."""
    parts = [c for c in ("step_computing", "step_comm", "step_free") if c in fields]
    most = rows.agg(F.max(sum((F.coalesce(F.col(c), F.lit(0.0)) for c in parts), F.lit(0.0))).alias("__m"))
    scale = F.when(F.col("__m") < 2000, 1000.0).otherwise(1.0)
    return rows.join(F.broadcast(most)).withColumns({c: F.col(c) * scale for c in fields}).drop("__m")
