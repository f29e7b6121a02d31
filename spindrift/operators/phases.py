"""Steps and phases: where steps come from, how they are labelled, what happened in each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions import scalars as S
from spindrift.functions.tables import kept
from spindrift.operators import intervals as I  # noqa: E741
from spindrift.plans import rules


def cumulative_steps(table: DataFrame, total: str = "total_us") -> DataFrame:
    """(step, ws, we) of a step table without start times: each step begins where the one before ends."""
    run = table.selectExpr("step", f"coalesce(sum({total}) over (order by step rows between unbounded preceding and 1 preceding), 0) as ws", f"{total} as t")  # steps, not events
    return run.selectExpr("step", "cast(ws as bigint) as ws", "cast(ws + t as bigint) as we")


def rescaled(table: DataFrame, total: str, limit: float = 2000.0) -> DataFrame:
    """Adds ``scale``: 1000 if every step's total is below ``limit`` (milliseconds then), else 1."""
    most = table.agg(F.max(total).alias("__m"))
    return table.join(F.broadcast(most)).withColumn("scale", F.when(F.col("__m") < limit, 1000).otherwise(1)).drop("__m")


def marker_steps(events: DataFrame, is_marker=None, phase=None) -> DataFrame:
    """(step, ws, we, declared): steps from markers, each ending where the next begins, the last at its own end; empty ones go.

    Markers are the rows for which ``is_marker`` holds (all, if it isn't given), in the order of ts and idx; ``phase`` is the phase
    that a marker declares.
    """
    marks = events if is_marker is None else events.where(is_marker)
    marks = marks.select("ts", "te", "idx", (F.lit(None).cast("string") if phase is None else phase).alias("declared"))
    run = marks.selectExpr("ts as ws", "idx", "declared", "coalesce(lead(ts) over (order by ts, idx), te) as we").where("we > ws")  # markers, not events
    return run.selectExpr("cast(row_number() over (order by ws, idx) - 1 as int) as step", "ws", "we", "declared")


def phase_markers(events: DataFrame, side: DataFrame | None = None) -> DataFrame:
    """(ts, te, idx, phase): markers in a timeline that name a phase, and those of ``side`` (ts, dur, text), a marker side-car."""
    text = "concat_ws(' ', raw_name, message)" if "message" in events.columns else "raw_name"
    own = events.where(F.expr(f"raw_name rlike '(?i){rules.MARKER_NAMES}'")).select("ts", "te", "idx", S.named_phase(F.expr(text)).alias("phase"))
    if side is not None:
        own = own.unionByName(side.select("ts", F.expr("ts + coalesce(dur, 0)").alias("te"), F.expr("-1 - monotonically_increasing_id()").alias("idx"), S.named_phase("text").alias("phase")))
    return own.where("phase is not null")


def whole_window(events: DataFrame) -> DataFrame:
    """(step, ws, we): all events as one step; none without events."""
    return events.agg(F.min("ts").alias("ws"), F.max("te").alias("we")).where("ws is not null").selectExpr("0 as step", "ws", "we")


def engine_steps(events: DataFrame, pattern: str = rules.ENGINE_STEPS, least: int = 3) -> DataFrame:
    """(name, ws, we): outermost runs of the host operator that marks engine steps.

    The operator is the most frequent match (then the one with most time, then by name) with at least ``least`` runs; runs inside an
    earlier one don't count. The operator's runs are written as a table first, as they are read more than once.
    """
    host = events.where((F.col("device") == "host") & F.col("name").rlike("(?i)" + pattern))
    best = host.groupBy("name").agg(F.count("*").alias("n"), F.sum("dur").alias("t")).where(f"n >= {least}").orderBy(F.desc("n"), F.desc("t"), "name").limit(1).select(F.col("name").alias("__n"))
    own = host.join(F.broadcast(best), host["name"] == best["__n"], "left_semi")
    own = kept(own.select("name", "ts", "te", "idx"), "engine-runs")
    rows = I.in_parts(own, "ts")
    top = rows.selectExpr("*", "max(te) over (partition by __part order by ts, te desc, idx rows between unbounded preceding and 1 preceding) as m")
    top = I.with_earlier(top, "max(te)", "max(__v)", "before").selectExpr("name", "ts as ws", "te as we", "greatest(m, before) as m")
    return top.where("m is null or ws >= m").select("name", "ws", "we")


def gap_segments(events: DataFrame, least: int = 200, factor: int = 4) -> DataFrame:
    """(segment, ws, we, n): runs of events without a long pause; long: over ``factor`` times the upper-median gap and over ``least``.

    Works on islands: a pause between events is a pause between merged intervals. The median is exact: classes of gaps two per
    cent wide are counted first, then the values of the one class that holds it. The islands are written as a table first, as they are read more than once.
    """
    merged = kept(I.islands(events, [], "ts", "te").select("start", "end"), "islands")
    merged = I.in_parts(merged, "start")
    pauses = merged.selectExpr("*", "lag(`end`) over (partition by __part order by start) as p")
    pauses = I.with_earlier(pauses, "max(`end`)", "max(__v)", "before").selectExpr("__part", "start", "`end`", "start - coalesce(p, before) as gap")
    long = pauses.where("gap > 0").selectExpr("gap", "cast(floor(log2(gap) * 32) as int) as class")
    classes = long.groupBy("class").agg(F.count("*").alias("c")).selectExpr("class", "c", "sum(c) over (order by class) - c as below", "sum(c) over () div 2 as place")  # 2048 rows at most
    values = long.join(F.broadcast(classes.where("below <= place and place < below + c")), "class").groupBy("gap", "below", "place").agg(F.count("*").alias("n"))
    middle = values.selectExpr("gap", "place", "below + sum(n) over (order by gap) as upto").where("upto > place").agg(F.min("gap").alias("m"))
    pauses = pauses.join(F.broadcast(middle)).selectExpr("__part", "start", "`end`", f"cast(coalesce(gap > greatest({least}, {factor} * coalesce(m, 0)), false) as int) as cut")
    run = pauses.selectExpr("*", "sum(cut) over (partition by __part order by start rows unbounded preceding) as own")
    cut = I.with_earlier(run, "sum(cut)", "sum(__v)", "before").selectExpr("cast(own + coalesce(before, 0) as int) as segment", "start", "`end`")
    return cut.groupBy("segment").agg(F.min("start").alias("ws"), F.max("end").alias("we"))


def two_means(values: DataFrame, value: str, rounds: int = 64, least: float = 0.35) -> DataFrame:
    """One row: centroids (log10) of a split of positive values into two, whether they are ``least`` apart, and the limit between them (``cut`` is not rounded).

    Lloyd's iteration over the histogram of values, folded inside one expression; the histogram has a row for each distinct
    rounded logarithm (four decimals), so its size doesn't follow the data.
    """
    hist = values.where(f"`{value}` > 0").selectExpr(f"cast(floor(log10(cast(`{value}` as double)) * 10000 + 0.5) as bigint) as x").groupBy("x").agg(F.count("*").alias("c"))
    one = hist.agg(F.sort_array(F.collect_list(F.struct("x", "c"))).alias("h")).where("size(h) > 0")
    sums = "aggregate(h, named_struct('a', 0D, 'n', 0D, 'b', 0D, 'm', 0D), (s, p) -> if(abs(p.x - z.lo) <= abs(p.x - z.hi), named_struct('a', s.a + p.x * p.c, 'n', s.n + p.c, 'b', s.b, 'm', s.m), named_struct('a', s.a, 'n', s.n, 'b', s.b + p.x * p.c, 'm', s.m + p.c)), s -> named_struct('lo', if(s.n > 0, s.a / s.n, z.lo), 'hi', if(s.m > 0, s.b / s.m, z.hi)))"
    fold = f"aggregate(sequence(1, {rounds}), named_struct('lo', cast(h[0].x as double), 'hi', cast(h[size(h) - 1].x as double)), (z, i) -> {sums})"
    out = one.selectExpr("aggregate(h, 0L, (s, p) -> s + p.c) as n", "(h[size(h) - 1].x - h[0].x) / 10000D as spread", f"{fold} as z")
    ok = f"n >= 4 and spread >= {least} and (z.hi - z.lo) / 10000 >= {least}"
    return out.select("n", S.round_half_up(F.expr("z.lo / 10000"), 4).alias("low"), S.round_half_up(F.expr("z.hi / 10000"), 4).alias("high"), F.expr(ok).alias("split"), S.round_half_up(F.expr("pow(10D, (z.lo + z.hi) / 20000)"), 2).alias("limit_us"), F.expr("pow(10D, (z.lo + z.hi) / 20000)").alias("cut"))


def labelled(steps: DataFrame, value: str, markers: DataFrame | None = None) -> DataFrame:
    """``steps`` with phase, method and confidence.

    Declared phases (columns ``stage`` or ``declared``) decide if any step has one, others are unknown then. Else phase markers
    (``ts``, ``phase``; steps have ws and we then): the first one inside a step names it. Else two clear clusters of durations (the
    longer: prefill), else steps of much the same length (decode), else unknown.
    """
    names = steps.columns
    declared = [S.named_phase(F.col(c)) for c in ("stage", "declared") if c in names]
    stage = "count(stage) > 0" if "stage" in names else "false"
    x = steps.withColumn("__d", F.coalesce(*declared) if declared else F.lit(None).cast("string")).withColumn("__m", F.lit(None).cast("string"))
    if markers is not None and {"ws", "we"} <= set(names):
        first = I.contained(markers, steps.select("step", "ws", "we"), "ts").groupBy("step").agg(F.min_by("phase", F.struct("ts", "idx")).alias("__p"))
        x = x.drop("__m").join(first, "step", "left").withColumnRenamed("__p", "__m")
    any_marker = F.lit(0).alias("k") if markers is None else F.lit(1 if markers.limit(1).count() else 0).alias("k")
    long = F.when(F.col(value) > 0, F.col(value))
    spread = x.agg(F.count(long).alias("c"), F.avg(long).alias("a"), F.stddev_pop(long).alias("d"), F.count("__d").alias("said"), F.expr(stage).alias("staged"), any_marker)
    split = two_means(steps, value).select("split", "cut")
    both = x.join(F.broadcast(spread.join(F.broadcast(split), how="left")))  # one row
    both = both.withColumn("split", F.coalesce("split", F.lit(False))).withColumn("even", F.expr("coalesce(c >= 8 and d / a < 0.25, false)"))
    both = both.withColumn("phase", F.expr(f"case when said > 0 then coalesce(__d, 'unknown') when k > 0 then coalesce(__m, 'unknown') when split then if(`{value}` >= cut, 'prefill', 'decode') when even then 'decode' else 'unknown' end"))
    both = both.withColumn("method", F.expr("case when said > 0 then if(staged, 'step-table-stage', 'marker-labels') when split then 'duration-bimodal' when k > 0 then 'marker-windows' when even then 'uniform-decode' else 'undetermined' end"))
    mixed = both.agg((F.count_if(F.col("phase") == "prefill") > 0).alias("p"), (F.count_if(F.col("phase") != "prefill") > 0).alias("q"))
    sure = "case when said > 0 then 'high' when split then if(p and q, 'medium', 'low') when k > 0 then 'medium' else 'low' end as confidence"
    return both.join(F.broadcast(mixed)).selectExpr(*(f"`{n}`" for n in names), "phase", "method", sure)


def step_metrics(events: DataFrame, steps: DataFrame) -> DataFrame:
    """One row for each step with events: busy time of both sides, idle time, time of each category, communication overlap and exposure."""
    inside = I.contained(events, steps, "ts")
    busy = I.sweep(inside, "device", "device", "host", ["step"], "ts", "te")
    comm = I.sweep(inside.where("device = 'device'"), "category", "comm", "compute", ["step"], "ts", "te").selectExpr("step", "left_us as comm_us", "both_us as comm_overlap_us", "left_only_us as comm_exposed_us")
    sums = inside.groupBy("step").agg(F.count("*").alias("events"), *(F.coalesce(F.sum(F.expr(f"case when device = 'device' and category = '{c}' then dur end")), F.lit(0)).cast("long").alias(f"{c}_sum_us") for c in ("compute", "copy")))
    out = steps.join(sums, "step").join(busy, "step", "left").join(comm, "step", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    wall = F.col("we") - F.col("ws")
    return out.select(
        "step", wall.alias("wall_us"), "events", zero("left_us").alias("device_busy_us"), zero("right_us").alias("host_busy_us"), F.greatest(F.lit(0).cast("long"), wall - zero("left_us")).alias("idle_us"), zero("compute_sum_us").alias("compute_us"),
        zero("copy_sum_us").alias("copy_us"), zero("comm_us").alias("comm_us"), zero("comm_overlap_us").alias("comm_overlap_us"), zero("comm_exposed_us").alias("comm_exposed_us"),
    )


def phase_summary(metrics: DataFrame) -> DataFrame:
    """One row for each phase: steps, sums, mean, shortest and longest step, shares of the wall time."""
    out = metrics.groupBy("phase").agg(
        F.count("*").alias("steps"), F.sum("wall_us").alias("wall_us"), F.min("wall_us").alias("min_step_us"), F.max("wall_us").alias("max_step_us"), F.sum("device_busy_us").alias("device_busy_us"), F.sum("comm_us").alias("comm_us"), F.sum("compute_us").alias("compute_us"),
    )
    return out.select("*", S.round_half_up(F.col("wall_us") / F.col("steps")).alias("avg_step_us"), S.round_half_up(S.percent_of("device_busy_us", "wall_us")).alias("busy_pct"), S.round_half_up(S.percent_of("comm_us", "wall_us")).alias("comm_pct"))


def choose_steps(candidates: list[tuple[str, DataFrame]]) -> tuple[str, DataFrame]:
    """First source of steps that has any: table, markers, engine runs, pauses, the whole window."""
    for name, steps in candidates:
        if not steps.isEmpty():
            return name, steps
    return candidates[-1]
