"""From events and tables to a data set: rebasing, operator statistics, table reconciliation, categories, rankings, sampling.

Events carry idx, ts, te, dur (microseconds), device, category, name, stream, rank; what is said of names applies per side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions import scalars as S
from spindrift.plans import rules


def rebased(events: DataFrame, mode: str = "rebase") -> DataFrame:
    """Adds ``offset`` and ``rel``: time since the rank's first event; events without rank use the smallest offset; ``raw`` shifts nothing."""
    if mode == "raw":
        return events.selectExpr("*", "0L as offset", "ts as rel")
    first = events.groupBy("rank").agg(F.min("ts").alias("low"))  # one row for each rank
    least = first.agg(F.min("low").alias("least"))
    offsets = first.join(F.broadcast(least)).selectExpr("rank as __r", "case when rank is null then least else low end as offset")
    return events.join(F.broadcast(offsets), events["rank"].eqNullSafe(offsets["__r"])).drop("__r").withColumn("rel", F.expr("ts - offset"))


def window_of(events: DataFrame, start: str = "ts", end: str = "te") -> DataFrame:
    """(ws, we): first start and last end."""
    return events.agg(F.min(start).alias("ws"), F.max(end).alias("we"))


def counts(events: DataFrame) -> DataFrame:
    """One row: events, events of each side, ranks, operators."""
    return events.agg(F.count("*").alias("events"), F.count_if(F.col("device") == "host").alias("host_events"), F.count_if(F.col("device") == "device").alias("device_events"), F.countDistinct("rank").alias("ranks"), F.countDistinct("device", "name").alias("operators"))


#: Classes of a power of two in which values are counted first.
CLASSES = 32


def quantiles(values: DataFrame, keys: list[str], value: str, shares: dict[str, float], middle: bool = False) -> DataFrame:
    """(keys, names of ``shares``): for each key the value at each share of its non-null values, exactly.

    The nearest rank from below, as ``percentile_disc``; with ``middle`` the mean of both values about the place, as ``percentile``.
    Values are counted before they are shuffled by key and value, so a key with a large part of all rows is spread by its values.
    Counts by logarithmic class (two per cent wide, at most some 4,000 a key) tell the class that holds a rank; only values of such a
    class are put in order. No buffer holds the values of a key. Whole numbers and doubles; keys may be null.
    """
    by, x = [f"`{k}`" for k in keys], f"`{value}`"
    kind = f"cast(case when {x} = 0 then 0 else sign({x}) * (1100 * {CLASSES} + floor(log2(cast(abs({x}) as double)) * {CLASSES})) end as int) as __c"
    counts = values.where(f"{x} is not null").groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__n")).selectExpr(*by, "__v", "__n", kind.replace(x, "__v"))
    over = f"over (partition by {', '.join(by) or '1'} order by __c)"
    classes = counts.groupBy(*keys, "__c").agg(F.sum("__n").alias("__m")).selectExpr(*by, "__c", "__m", f"sum(__m) {over} - __m as __below", f"sum(__m) over (partition by {', '.join(by) or '1'}) as __all")
    place = "({0}D * (__all - 1))" if middle else "(greatest(1, ceil({0}D * __all)) - 1)"
    asked = ", ".join(f"named_struct('__share', '{k}', '__lo', cast(floor({place.format(q)}) as bigint), '__hi', cast(ceil({place.format(q)}) as bigint), '__at', cast({place.format(q)} as double))" for k, q in shares.items())
    held = classes.selectExpr(*(f"{k} as `__k{i}`" for i, k in enumerate(by)), "__c as __d", "__below", "__m", f"inline(array({asked}))").where("__hi >= __below and __lo < __below + __m")
    on = counts["__c"] == held["__d"]
    for i, k in enumerate(keys):
        on = on & counts[k].eqNullSafe(held[f"__k{i}"])
    run = f"sum(__n) over (partition by {', '.join([*by, '__c', '__share'])} order by __v)"
    found = counts.join(held, on).selectExpr(*by, "__share", "__lo", "__hi", "__at", "__v", f"__below + {run} as __upto", "__n")
    found = found.where("__upto > __lo and __upto - __n <= __hi")
    pick = lambda k, rank: f"max(case when __share = '{k}' and {rank} < __upto and {rank} >= __upto - __n then __v end)"
    if middle:
        cells = {k: f"{pick(k, '__lo')} + ({pick(k, '__hi')} - {pick(k, '__lo')}) * max(case when __share = '{k}' then __at - __lo end)" for k in shares}
    else:
        cells = {k: pick(k, "__lo") for k in shares}
    return found.groupBy(*keys).agg(*(F.expr(c).alias(k) for k, c in cells.items()))


def operator_stats(events: DataFrame, streams: int = 16) -> DataFrame:
    """Statistics of each operator on each side: count, total, mean, longest, nearest-rank percentiles, streams, ranks, ambiguity."""
    out = events.groupBy("device", "name").agg(
        F.count("*").alias("count"), F.sum("dur").alias("total_us"), F.max("dur").alias("max_us"),
        F.slice(F.array_sort(F.collect_set("stream")), 1, streams).alias("streams"), F.countDistinct("rank").alias("ranks"), (F.countDistinct("category") > 1).alias("ambiguous"),
    )
    ranks = quantiles(events, ["device", "name"], "dur", {"p50_us": 0.5, "p95_us": 0.95}).withColumnsRenamed({"device": "__d", "name": "__n"})
    out = out.join(ranks, out["device"].eqNullSafe(ranks["__d"]) & out["name"].eqNullSafe(ranks["__n"]), "left").drop("__d", "__n")
    return out.withColumns({c: F.col(c).cast("double") for c in ("p50_us", "p95_us")}).withColumn("avg_us", S.round_half_up(F.col("total_us") / F.col("count")))


def dominant_category(events: DataFrame) -> DataFrame:
    """(device, name, category, total_us): category with most time; the one seen first wins ties."""
    each = events.groupBy("device", "name", "category").agg(F.sum("dur").alias("total_us"), F.min("idx").alias("first"))
    best = each.groupBy("device", "name").agg(F.max_by(F.struct("category", "total_us"), F.struct(F.col("total_us"), -F.col("first"))).alias("b"))
    return best.select("device", "name", "b.category", "b.total_us")


def longest_sample(events: DataFrame) -> DataFrame:
    """(device, name, idx, dur, ts): the longest event of each operator; the earliest index wins ties."""
    best = events.groupBy("device", "name").agg(F.max_by(F.struct("idx", "dur", "ts"), F.struct(F.col("dur"), -F.col("idx"))).alias("b"))
    return best.select("device", "name", "b.idx", "b.dur", "b.ts")


def category_totals(events: DataFrame) -> DataFrame:
    """One row for each of the five categories: total, host and device time, count and share."""
    spark = events.sparkSession
    names = spark.createDataFrame([(c, i) for i, c in enumerate(rules.CATEGORIES)], "category string, place int")
    each = events.groupBy("category").agg(F.sum("dur").alias("t"), F.sum(F.expr("case when device = 'host' then dur end")).alias("h"), F.sum(F.expr("case when device = 'device' then dur end")).alias("d"), F.count("*").alias("n"))
    all_ = each.agg(F.sum("t").alias("whole"))
    out = F.broadcast(names).join(each, "category", "left").join(F.broadcast(all_))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return out.select("category", zero("t").alias("total_us"), zero("h").alias("host_us"), zero("d").alias("device_us"), zero("n").alias("count"), S.round_half_up(S.percent_of(zero("t"), F.col("whole"))).alias("share_pct"))


def ranked(stats: DataFrame, by: str = "total_us", top: int = 20) -> DataFrame:
    """The ``top`` operators by a column, with rank and share of the whole."""
    whole = stats.agg(F.sum("total_us").alias("whole"))
    best = stats.orderBy(F.col(by).desc(), "device", "name").limit(top)  # TakeOrderedAndProject
    best = best.selectExpr("*", f"cast(row_number() over (order by {by} desc, device, name) as int) as rank")  # ``top`` rows
    return best.join(F.broadcast(whole)).withColumn("share_pct", S.round_half_up(S.percent_of("total_us", "whole"))).drop("whole")


def with_overflow(stats: DataFrame, top: int = 120) -> DataFrame:
    """The ``top`` operators of each side by time, and one row ``(other)`` folding the rest: sums, mean of means, percentiles of percentiles."""
    placed = stats.selectExpr("*", "row_number() over (partition by device order by total_us desc, name) as place")
    head = placed.where(f"place <= {top}").selectExpr("device", "name", "count", "total_us", "avg_us", "max_us", "p50_us", "p95_us", "0L as folded")
    tail = placed.where(f"place > {top}").groupBy("device").agg(
        F.sum("count").alias("count"), F.sum("total_us").alias("total_us"), S.round_half_up(F.avg("avg_us")).alias("avg_us"), F.max("max_us").alias("max_us"), F.expr("percentile_disc(0.5) within group (order by p50_us)").alias("p50_us"),
        F.expr("percentile_disc(0.95) within group (order by p95_us)").alias("p95_us"), F.count("*").alias("folded"),
    )
    return head.unionByName(tail.withColumn("name", F.lit("(other)")))


def table_stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics of table rows (count, dur_us, wait_us; mac50, mte2_100): totals and metrics weighted by duration."""
    weight = F.coalesce(F.col("dur_us"), F.lit(1))
    mean = lambda c, unit: S.round_half_up(F.sum(F.col(c) * weight) / F.sum(weight) / unit, 4)
    return rows.groupBy(*keys).agg(F.count("*").alias("count"), F.sum("dur_us").alias("total_us"), F.sum("wait_us").alias("wait_us"), F.countDistinct("device_id").alias("devices"), mean("mac50", 50).alias("mac"), mean("mte2_100", 10).alias("mte2"))


def believed(stats: DataFrame) -> DataFrame:
    """For each name the statistics (count, total_us) of the first table kind in the order of belief that has it, with all kinds that do."""
    order = F.array_position(F.array(*map(F.lit, rules.KIND_PRIORITY)), F.col("kind"))
    best = stats.groupBy("name").agg(F.min_by(F.struct("kind", "count", "total_us"), order).alias("b"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    return best.select("name", "b.kind", "b.count", "b.total_us", F.array_join("kinds", ",").alias("kinds"))


def disagreeing(stats: DataFrame, most: float = 0.2) -> DataFrame:
    """Names whose tables differ by more than ``most`` of the largest total; API tables don't count."""
    each = stats.where("kind <> 'api_statistic' and total_us > 0").groupBy("name").agg(F.max("total_us").alias("high"), F.min("total_us").alias("low"), F.count("*").alias("tables"))
    return each.where((F.col("tables") >= 2) & ((F.col("high") - F.col("low")) / F.col("high") > most)).withColumn("spread", S.round_half_up((F.col("high") - F.col("low")) / F.col("high"), 4))


def merged(trace: DataFrame, tables: DataFrame, sampled: bool = False) -> DataFrame:
    """Trace operators (device, name, count, total_us) beside table operators (name, count, total_us, ``kind``), both sides kept.

    A complete trace is believed, a sampled one gives way to the table. ``cross_check_pct``: how far the other source is off.
    """
    t = trace.select("device", "name", F.col("count").alias("trace_count"), F.col("total_us").alias("trace_us"))
    c = tables.select(F.col("name").alias("__n"), F.col("count").alias("table_count"), F.col("total_us").alias("table_us"))
    both = t.join(c, t["name"] == c["__n"], "full_outer")
    use = F.col("table_us").isNotNull() if sampled else F.col("trace_us").isNull()
    total = F.when(use, F.col("table_us")).otherwise(F.col("trace_us"))
    other = F.when(use, F.col("trace_us") - F.col("table_us")).otherwise(F.col("table_us") - F.col("trace_us"))
    check = F.when(F.col("table_us").isNotNull() & F.col("trace_us").isNotNull() & (F.col("trace_us") != 0), S.round_half_up(other / F.greatest(F.lit(1), total) * 100, 1))
    return both.select(
        F.coalesce("name", "__n").alias("name"), F.coalesce("device", F.lit("device")).alias("device"), F.when(use, F.col("table_count")).otherwise(F.col("trace_count")).alias("count"), total.alias("total_us"),
        F.col("trace_us"), F.col("table_us"), F.when(use, "table").otherwise("trace").alias("source"), check.alias("cross_check_pct"),
    )


def weighted_metrics(rows: DataFrame) -> DataFrame:
    """(metric, value, weight): each hardware metric over all rows, weighted by duration, heaviest first."""
    long = rows.selectExpr("dur_us", "inline(array(named_struct('metric', 'mac', 'v', mac50, 'unit', 50.0D), named_struct('metric', 'mte2', 'v', mte2_100, 'unit', 10.0D)))")
    out = long.groupBy("metric").agg(F.sum(F.expr("v * dur_us")).alias("a"), F.sum("dur_us").alias("weight"), F.max("unit").alias("unit"))
    return out.select("metric", S.round_half_up(F.col("a") / F.col("weight") / F.col("unit"), 4).alias("value"), "weight")


def throughput(rows: DataFrame, flops: str, dur_us: str, peak_tflops: float) -> DataFrame:
    """One row: work per second in TFLOP/s and its share of the peak."""
    out = rows.agg(F.sum(flops).alias("f"), F.sum(dur_us).alias("d"))
    rate = F.col("f") / (F.col("d") / 1e6) / 1e12
    return out.select(S.round_half_up(rate, 6).alias("tflops"), S.round_half_up(S.percent_of(rate, F.lit(peak_tflops)), 4).alias("of_peak_pct"))


def stride_sampled(events: DataFrame, budget: int, long_us: int) -> DataFrame:
    """Events that stride sampling at a budget keeps: the important, every stride-th (stride = ceil(seen / budget)), and the long.

    ``seen`` counts arrivals by idx. The running number is local to slices of the order plus the counts of the slices before.
    """
    width = 1 << 20
    sliced = events.withColumn("__s", F.expr(f"idx div {width}"))
    n = sliced.groupBy("__s").agg(F.count("*").alias("__c")).selectExpr("__s as __k", "coalesce(sum(__c) over (order by __s rows between unbounded preceding and 1 preceding), 0) as __b")  # a row for each million events
    seen = sliced.selectExpr("*", "row_number() over (partition by __s order by idx) as __r").join(F.broadcast(n), F.col("__s") == F.col("__k")).withColumn("seen", F.expr("__b + __r"))
    seen = seen.withColumn("stride", F.expr(f"cast(ceil(seen / {budget}) as bigint)"))
    return seen.where(S.important("raw_name") | F.expr("seen % stride = 0") | (F.col("dur") >= long_us)).drop("__s", "__k", "__b", "__r")


def begin_end_pairs(marks: DataFrame, keys: list[str], order: str, ts: str, phase: str) -> DataFrame:
    """(keys, ts, dur): ends whose predecessor in the same group is a begin; a later begin replaces an open one."""
    by = f"over (partition by {', '.join(keys)} order by {order})"
    return marks.where(f"{phase} in ('B', 'E')").selectExpr("*", f"lag({phase}) {by} as p", f"lag({ts}) {by} as b").where(f"{phase} = 'E' and p = 'B'").selectExpr(*keys, f"b as {ts}", f"{ts} - b as dur")


def time_unit(events: DataFrame) -> DataFrame:
    """One row: whether durations look like milliseconds (over 30 % of the positive ones below 0.05, or a span over six hours in us)."""
    out = events.agg(F.count_if((F.col("dur") > 0) & (F.col("dur") < 0.05)).alias("tiny"), F.count_if(F.col("dur") > 0).alias("positive"), (F.max("te") - F.min("ts")).alias("span"))
    return out.select("tiny", "positive", "span", F.when((F.col("tiny") > 0.3 * F.col("positive")) | (F.col("span") > 6 * 3600 * 1e6), "ms").otherwise("us").alias("unit"))


def time_units(events: DataFrame) -> DataFrame:
    """(path, unit) of each trace, by the rule of ``time_unit`` over ts_us and dur_us."""
    out = events.groupBy("path").agg(F.count_if((F.col("dur_us") > 0) & (F.col("dur_us") < 0.05)).alias("tiny"), F.count_if(F.col("dur_us") > 0).alias("positive"), (F.max("ts_us") - F.min("ts_us")).alias("span"))
    return out.select("path", F.when((F.col("tiny") > 0.3 * F.col("positive")) | (F.col("span") > 6 * 3600 * 1e6), "ms").otherwise("us").alias("unit"))


def in_microseconds(events: DataFrame, units: DataFrame) -> DataFrame:
    """``events`` with ts_us and dur_us of traces in milliseconds a thousand times as large; ``units`` has a row for each trace."""
    scale = F.when(F.col("__u") == "ms", 1000).otherwise(1)
    joined = events.join(F.broadcast(units.select(F.col("path").alias("__p"), F.col("unit").alias("__u"))), F.col("path") == F.col("__p"), "left")
    scaled = joined.withColumn("ts_us", (F.col("ts_us") * scale).cast("decimal(20,3)")).withColumn("dur_us", F.col("dur_us") * scale)
    return scaled.drop("__p", "__u")


def first_seen(rows: DataFrame, value: str, place: str) -> DataFrame:
    """Distinct values in the order of their first place."""
    return rows.groupBy(value).agg(F.min(place).alias("first_place"), F.count("*").alias("n"))


def evicted(entries: DataFrame, keep: int, oldest: int, now: int) -> DataFrame:
    """Entries (id, last_access) with whether they go: beyond the ``keep`` latest, or older than ``oldest``."""
    return entries.selectExpr("id", "last_access", "row_number() over (order by last_access desc, id) as place").selectExpr("id", "last_access", f"place > {keep} or {now} - last_access > {oldest} as evicted")
