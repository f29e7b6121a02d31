"""What a page shows of a capture, and numeric kernels over vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions import scalars as S
from spindrift.operators import dataset as D
from spindrift.operators import intervals as I  # noqa: E741


def event_budget(stats: DataFrame, budget: int, floor: int) -> DataFrame:
    """(device, name, count, quota): events of each operator that fit a budget.

    Each gets its share of time, ``floor`` at least and its count at most; what is left goes to the heaviest in turn. One row for
    each operator comes here, not events.
    """
    whole = stats.agg(F.sum("total_us").alias("__w"))
    q = stats.join(F.broadcast(whole)).selectExpr("device", "name", "count", "total_us", f"least(count, greatest({floor}, cast(floor({budget} * (cast(total_us as double) / __w)) as bigint))) as q")
    used = q.agg(F.sum("q").alias("__u"))
    h = q.join(F.broadcast(used)).selectExpr("*", f"greatest(0, {budget} - __u) as spare", "count - q as room")
    h = h.selectExpr("*", "coalesce(sum(room) over (order by total_us desc, device, name rows between unbounded preceding and 1 preceding), 0) as before")
    return h.selectExpr("device", "name", "count", "q + least(room, greatest(0, spare - before)) as quota")


#: Indexes in a block that is counted as one when events of equal length don't all fit.
TIES = 1024


def within_quota(events: DataFrame, quotas: DataFrame) -> DataFrame:
    """The events of each operator that its quota holds: the longest, of equally long ones those with the smallest ``idx``.

    ``quotas`` is (device, name, quota), one row for each operator; events of others go. Events are not sorted to drop most of them.
    Counts of the lengths of each operator (by classes two per cent wide first) give the length at which its quota ends, and counts
    of blocks of indexes where among equal lengths; a filter then leaves little more than the quotas, and only that is ranked.
    """
    key = ["device", "name"]
    q = quotas.selectExpr("device as __d", "name as __o", "quota as __quota").where("__quota > 0")
    same = lambda x: (x["device"].eqNullSafe(F.col("__d"))) & (x["name"].eqNullSafe(F.col("__o")))
    counts = events.groupBy(*key, "dur").agg(F.count("*").alias("n")).selectExpr("*", f"cast(if(dur > 0, floor(log2(cast(dur as double)) * {D.CLASSES}), -100000) as int) as c")
    classes = counts.groupBy(*key, "c").agg(F.sum("n").alias("m")).selectExpr("*", "sum(m) over (partition by device, name order by c desc) as upto")
    ends = classes.join(q, same(classes)).where("upto >= __quota and upto - m < __quota").selectExpr("__d", "__o", "c as __c", "upto - m as __above", "__quota")
    values = counts.join(ends, same(counts) & (counts["c"] == F.col("__c"))).selectExpr("__d", "__o", "dur as __v", "n", "__quota", "__above + sum(n) over (partition by __d, __o order by dur desc) as upto")
    ends = values.where("upto >= __quota and upto - n < __quota").selectExpr("__d", "__o", "__v", "__quota - (upto - n) as __room", "n as __ties")
    limits = q.join(ends.withColumnsRenamed({"__d": "__e", "__o": "__p"}), F.expr("__d <=> __e and __o <=> __p"), "left").select("__d", "__o", "__v", "__room", "__ties")
    near = events.join(limits, same(events)).where("__v is null or dur >= __v or dur is null")
    sure, ties = near.where("__v is null or dur > __v or __room = __ties"), near.where("dur = __v and __room < __ties")
    sure = sure.where("__v is null or dur is not null")
    blocks = ties.groupBy(*key, "__room", F.expr(f"idx div {TIES}").alias("b")).agg(F.count("*").alias("m")).selectExpr("device as __f", "name as __g", "__room as __r", "b", "sum(m) over (partition by device, name order by b) - m as before")
    last = blocks.where("before < __r").groupBy("__f", "__g").agg(F.max("b").alias("__b"))
    ties = ties.join(last, F.expr("device <=> __f and name <=> __g")).where(f"idx div {TIES} <= __b")
    ties = ties.selectExpr(*(f"`{c}`" for c in near.columns), "row_number() over (partition by device, name order by idx) as __n").where("__n <= __room").drop("__n")
    return sure.unionByName(ties).select(*events.columns)


def page(capture_events: DataFrame, stats: DataFrame, budget: int = 150_000, operators: int = 400, ranking: int = 60, gaps: int = 30) -> dict[str, DataFrame]:
    """The parts of a page: ``operators`` by total time, both rankings, ``categories``, ``overlap`` of both sides, the longest idle ``gaps``, and the ``lanes`` with what a budget of events shows of each.

    Every part is bounded by its cap, the lanes by the budget.
    """
    columns = ["device", "name", "count", "total_us", "avg_us", "max_us", "p50_us", "p95_us"]
    top = lambda by, n: stats.orderBy(F.desc(by), "device", "name").limit(n).select(*columns, F.expr(f"cast(row_number() over (order by {by} desc, device, name) as int)").alias("place"))
    window = D.window_of(capture_events)
    idle = I.gaps(capture_events.where("device = 'device'"), window, 0, [], "ts", "te").orderBy(F.desc("dur"), "start").limit(gaps)
    quota = event_budget(stats, budget, 8)
    shown = within_quota(capture_events.select("device", "name", "idx", "ts", "dur"), quota).groupBy("device", "name").agg(F.sort_array(F.collect_list(F.struct("ts", "dur", "idx"))).alias("events"))
    lanes = stats.select("device", "name", "count", "total_us").join(shown, ["device", "name"], "left").withColumn("truncated", F.expr("count > coalesce(size(events), 0)"))
    return {"operators": top("total_us", operators), "by_total": top("total_us", ranking), "by_average": top("avg_us", ranking), "categories": D.category_totals(capture_events), "overlap": I.sweep(capture_events, "device", "device", "host", [], "ts", "te"), "gaps": idle, "lanes": lanes}


def longest_per_row(events: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The ``n`` longest events of each lane, numbered in order of time."""
    by = ", ".join(keys)
    kept = events.selectExpr("*", f"row_number() over (partition by {by} order by dur desc, idx) as __n").where(f"__n <= {n}").drop("__n")
    return kept.selectExpr("*", f"cast(row_number() over (partition by {by} order by ts, idx) as int) as place")


def squarified(weights: list[float], width: float, height: float) -> list[tuple[float, float, float, float]]:
    """Rectangles (x, y, w, h) of a squarified treemap; weights in falling order, zero weights get empty rectangles."""
    total, out = sum(weights), []
    scale = width * height / total if total > 0 else 0.0
    areas, x, y, w, h, i = [v * scale for v in weights], 0.0, 0.0, width, height, 0
    worst = lambda row, side: max(max(side * side * a / sum(row) ** 2, sum(row) ** 2 / (side * side * a)) for a in row)
    while i < len(areas) and areas[i] > 0:
        side, row = min(w, h), [areas[i]]
        while i + len(row) < len(areas) and areas[i + len(row)] > 0 and worst(row + [areas[i + len(row)]], side) <= worst(row, side):
            row.append(areas[i + len(row)])
        thick, at = sum(row) / side, 0.0
        for a in row:
            out.append((x, y + at, thick, a / thick) if w >= h else (x + at, y, a / thick, thick))
            at += a / thick
        x, y, w, h = (x + thick, y, w - thick, h) if w >= h else (x, y + thick, w, h - thick)
        i += len(row)
    return out + [(x, y, 0.0, 0.0)] * (len(areas) - len(out))


def treemap(items: DataFrame, width: float, height: float) -> DataFrame:
    """(scope, item, x, y, w, h): layout of each scope's items; a fold over a few dozen rows for each scope."""

    def lay(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["weight", "item"], ascending=[False, True])
        boxes = squarified(part["weight"].tolist(), width, height)
        return part[["scope", "item"]].assign(**{k: [b[i] for b in boxes] for i, k in enumerate("xywh")})

    return items.groupBy("scope").applyInPandas(lay, "scope string, item string, x double, y double, w double, h double")


def row_norm(rows: DataFrame, x: str, eps: float = 1e-6) -> DataFrame:
    """Adds ``out``: each vector divided by its root mean square."""
    v = f"transform(`{x}`, x -> cast(x as double))"
    r = rows.selectExpr("*", f"{v} as __v").selectExpr("*", f"sqrt(aggregate(__v, 0D, (a, x) -> a + x * x) / size(__v) + {eps}D) as __r")
    return r.selectExpr("*", "transform(__v, x -> x / __r) as out").drop("__v", "__r")


def quantized(rows: DataFrame, x: str) -> DataFrame:
    """Adds ``scale`` (largest component / 127), ``q`` (int8 values), ``back`` (their values again) and ``worst`` (largest error)."""
    r = rows.selectExpr("*", f"transform(`{x}`, x -> cast(x as double)) as __v").selectExpr("*", "array_max(transform(__v, x -> abs(x))) / 127 as scale")
    r = r.selectExpr("*", "transform(__v, x -> if(scale = 0, 0, cast(floor(x / scale + 0.5D) as int))) as q").selectExpr("*", "transform(q, y -> y * scale) as back")
    return r.selectExpr("*", "array_max(zip_with(__v, back, (x, y) -> abs(x - y))) as worst").drop("__v")


def silu_product(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Adds ``out``: silu of the product of two vectors, component by component."""
    return rows.selectExpr("*", f"transform(zip_with(`{a}`, `{b}`, (x, y) -> cast(x as double) * cast(y as double)), z -> z / (1 + exp(-z))) as out")


def numeric_error(rows: DataFrame, actual: str, expected: str) -> DataFrame:
    """One row: largest absolute error, largest relative error over components of 1 % of the root mean square at least, and that."""
    long = rows.selectExpr(f"inline(arrays_zip(`{expected}`, `{actual}`)) as (x, y)")
    rms = long.agg(F.sqrt(F.avg(F.expr("x * x"))).alias("rms"))
    return long.join(F.broadcast(rms)).agg(F.max(F.expr("abs(x - y)")).alias("max_abs"), F.max(F.expr("case when abs(x) >= 0.01 * rms then abs(x - y) / abs(x) end")).alias("max_rel"), F.first("rms").alias("rms"))


def to_bfloat16(x: np.ndarray) -> np.ndarray:
    """Nearest bfloat16 values (ties to even), as float32."""
    bits = np.asarray(x, np.float32).view(np.uint32)
    return ((bits + 0x7FFF + ((bits >> 16) & 1)) & 0xFFFF0000).astype(np.uint32).view(np.float32)


def rounded(rows: DataFrame, x: str) -> DataFrame:
    """Adds ``f16`` and ``b16``: sums of the components in half precision and bfloat16 (Arrow batches, no row-wise Python)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            with np.errstate(over="ignore"):
                half = [float(np.asarray(v, np.float32).astype(np.float16).astype(np.float64).sum()) for v in part[x]]
            brain = [float(to_bfloat16(np.asarray(v, np.float32)).astype(np.float64).sum()) for v in part[x]]
            yield part.drop(columns=[x]).assign(f16=half, b16=brain)

    keep = [c for c in rows.columns if c != x]
    return rows.mapInPandas(run, rows.select(*keep).schema.add("f16", "double").add("b16", "double"))


def axis_ticks(low: float, high: float, about: int = 6) -> list[float]:
    """Round positions along an axis."""
    span = max(high - low, 1e-12)
    raw = span / max(1, about)
    unit = 10.0 ** np.floor(np.log10(raw))
    step = unit * next(m for m in (1, 2, 5, 10) if m * unit >= raw)
    first = np.ceil(low / step)
    return [float(round(k * step, 12)) for k in np.arange(first, np.floor(high / step) + 1)]


def bar_geometry(evidence: DataFrame) -> DataFrame:
    """Adds where a value and its threshold stand on a bar of 100: twice the threshold, or the value, is the whole."""
    whole = F.greatest(F.col("threshold") * 2, F.col("value"), F.lit(1e-9))
    return evidence.withColumn("value_at", S.round_half_up(F.col("value") / whole * 100)).withColumn("threshold_at", S.round_half_up(F.col("threshold") / whole * 100))
