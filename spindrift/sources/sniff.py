"""What an artifact is, and whether a set of artifacts is a capture."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions import scalars as S
from spindrift.plans import rules


def _weight(text: Column, markers: list) -> Column:
    return reduce(lambda a, b: a + b, (F.when(text.rlike("(?i)" + p), w).otherwise(0) for p, w in markers))


def kind_of(name: Column, head: Column) -> Column:
    """Artifact kind from name and first characters."""
    start = F.substring(F.ltrim(head), 1, 1)
    csv = name.rlike(r"(?i)\.csv$") | (F.length(F.regexp_replace(F.substring_index(head, "\n", 1), "[^,;\t]", "")) >= 2) & ~start.isin("{", "[")
    trace = head.rlike(r'"ph"\s*:') | head.rlike('"traceEvents"')
    return (
        F.when(name.rlike(r"(?i)\.db$") | head.startswith("SQLite format 3"), "sqlite")
        .when(name.rlike(r"(?i)\.(?:zip|tar|tgz|gz)$"), "archive")
        .when(start.isin("{", "[") & trace, "trace-json")
        .when(name.rlike(r"(?i)trace.*\.json$") & ((head == "") | start.isin("{", "[")), "trace-json")
        .when(start.isin("{", "["), "json-aux")
        .when(csv, S.table_kind(name))
        .when(name.rlike(r"(?i)\.(?:proto|pb|bin)$"), "proto")
        .otherwise("unknown")
    )


def sniffed(artifacts: DataFrame) -> DataFrame:
    """Adds kind, name_weight, content_weight, engine_marks, supported to artifacts (name, head)."""
    name, head = F.col("name"), F.coalesce(F.col("head"), F.lit(""))
    out = artifacts.withColumn("kind", kind_of(name, head)).withColumn("name_weight", _weight(name, rules.NAME_MARKERS)).withColumn("content_weight", _weight(head, rules.CONTENT_MARKERS))
    out = out.withColumn("engine_marks", reduce(lambda a, b: a + b, (F.concat_ws(" ", name, head).rlike("(?i)" + p).cast("int") for p, _ in rules.ENGINE_MARKERS)))
    return out.withColumn("supported", ~F.col("kind").isin("unknown", "sqlite"))


def validated(found: DataFrame, keys: list[str]) -> DataFrame:
    """For each set: weight, profile type (engine-npu, npu, unknown) and whether it can be analysed (a trace, a table or a record file)."""
    tables = [k for k, _ in rules.TABLE_KINDS if k != "pipe_utilization"]
    out = found.groupBy(*keys).agg(F.sum(F.col("name_weight") + F.col("content_weight")).alias("weight"), F.sum("engine_marks").alias("engine"), F.max(F.col("kind").isin(*tables, "trace-json", "proto")).alias("usable"), F.max("supported").alias("readable"))
    kind = F.when(F.col("engine") > 0, "engine-npu").when(F.col("weight") >= rules.LEAST_WEIGHT, "npu").otherwise("unknown")
    return out.withColumn("profile_type", kind).withColumn("ok", F.col("usable") & F.col("readable"))
