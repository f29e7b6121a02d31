"""Indicators, scores, causes, advice: rules evaluated as columns over one row for each scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions import scalars as S
from spindrift.operators import dataset as D
from spindrift.operators import intervals as I  # noqa: E741
from spindrift.plans import rules

R, P = S.round_half_up, S.percent_of


def indicators(events: DataFrame, scopes: DataFrame) -> DataFrame:
    """One row of measures for each scope.

    ``events`` carry device, category, subtype, role, name, ts, te, dur and, where message sizes are known, ``size_mb``; they are read
    three times, so a caller writes them first if they are costly. ``scopes`` has scope, phase, ws, we, steps: a few rows, which may
    overlap; an event belongs to those in which it starts. Interval measures and gaps come from one sweep over all scopes, sums from
    one aggregate over what events have in common, medians from counted values.
    """
    sides = {"d": "device = 'device'", "h": "device = 'host'", "c": "device = 'device' and category = 'comm'", "k": "device = 'device' and category = 'compute'"}
    spans = {"db": "d > 0", "hb": "h > 0", "d_only": "d > 0 and h = 0", "h_only": "h > 0 and d = 0", "cu": "c > 0", "co": "c > 0 and k > 0", "ce": "c > 0 and k = 0"}
    named = [(r["scope"], r["ws"], r["we"]) for r in scopes.collect()]  # the whole capture and its phases
    within = F.expr("filter(array({}), x -> x is not null)".format(", ".join(f"case when ts >= {a}L and ts < {max(b, a + 1)}L then '{n}' end" for n, a, b in named)))
    busy = I.sweeps_in(events, [(n, a, max(b, a + 1)) for n, a, b in named], sides, spans, "d", int(rules.MIN_GAP_US), "ts", "te").withColumnsRenamed({"longest": "gmax", "pauses": "gn"})
    # first by what rows have in common, then conditional sums over those few rows
    sync = F.expr(f"device = 'host' and name rlike '(?i){rules.SYNC_OPS}'").alias("sync")
    alike = events.groupBy(within.alias("scopes"), "device", "category", "subtype", "role", sync).agg(F.count("*").alias("n"), F.sum("dur").alias("d")).withColumn("scope", F.explode("scopes"))
    total = lambda test: F.coalesce(F.sum(F.expr(f"case when {test} then d end")), F.lit(0)).cast("double")
    many = lambda test: F.coalesce(F.sum(F.expr(f"case when {test} then n end")), F.lit(0)).cast("long")
    device = "device = 'device' and category"
    sums = alike.groupBy("scope").agg(
        F.sum("n").alias("n"), many("device = 'device'").alias("dn"), many("device = 'host'").alias("hn"), total(f"{device} = 'compute'").alias("ku"), total(f"{device} = 'copy'").alias("yu"), total("device = 'host' and category = 'copy'").alias("hy"), total("device = 'host'").alias("hs"),
        many(f"{device} = 'comm'").alias("cn"), total(f"{device} = 'copy' and subtype = 'd2h'").alias("d2h"), total(f"{device} = 'copy' and subtype = 'h2d'").alias("h2d"), many("device = 'host' and (role = 'framework' or category = 'schedule')").alias("disp"), total("sync").alias("su"), many("sync").alias("sn"),
        F.coalesce(F.max(F.expr(f"{device} = 'compute' and subtype = 'attention'")), F.lit(False)).alias("hasAttention"),
    )
    size = "named_struct('kind', 'cs', 'v', case when category = 'comm' and size_mb > 0 then cast(size_mb as double) end)" if "size_mb" in events.columns else None
    measured = ", ".join(filter(None, ["named_struct('kind', if(category = 'comm', 'cm', 'km'), 'v', cast(dur as double))", size]))
    values = events.where("device = 'device' and category in ('comm', 'compute')").select(F.explode(within).alias("scope"), "category", "dur", *(["size_mb"] if size else [])).selectExpr("scope", f"inline(array({measured}))")
    middle = D.quantiles(values, ["scope", "kind"], "v", {"m": 0.5}, middle=True)
    medians = middle.groupBy("scope").agg(*(F.max(F.when(F.col("kind") == k, F.col("m"))).alias(k) for k in ("cm", "km", "cs")))
    sums = sums.join(medians, "scope", "left")
    x = scopes.join(sums, "scope", "left").join(busy, "scope", "left")
    x = x.na.fill(0, [k for k in x.columns if k != "cs"])
    c = F.col
    wall = F.greatest(F.lit(1.0), (c("we") - c("ws")).cast("double"))
    per_step = lambda v, digits=2: R(F.when(c("steps") > 0, v / c("steps")).otherwise(0.0), digits)
    own = lambda v: F.greatest(F.lit(1), c(v))
    out = {
        "wallUs": R(wall), "stepCount": c("steps"), "eventCount": c("n"), "deviceEventCount": c("dn"), "hostEventCount": c("hn"), "deviceBusyUs": R(c("db")), "deviceBusyPct": R(P(c("db"), wall)), "hostBusyUs": R(c("hb")), "hostBusyPct": R(P(c("hb"), wall)),
        "idleUs": R(c("idle")), "idlePct": R(P(c("idle"), wall)), "hostOnlyUs": R(c("h_only")), "hostOnlyPct": R(P(c("h_only"), wall)), "deviceOnlyUs": R(c("d_only")), "deviceOnlyPct": R(P(c("d_only"), wall)), "commUs": R(c("cu")), "commPct": R(P(c("cu"), wall)),
        "commPctOfDevice": R(P(c("cu"), own("db"))), "commExposedUs": R(c("ce")), "commExposedPct": R(P(c("ce"), wall)), "commOverlapPct": R(P(c("co"), own("cu"))), "commEventCount": c("cn"), "commPerStep": per_step(c("cn")), "commUsPerStep": per_step(c("cu")),
        "commLatencyMedianUs": R(c("cm")), "commSizeMedianMb": F.when(c("cs").isNotNull(), R(c("cs"), 3)), "computeUs": R(c("ku")), "computePct": R(P(c("ku"), wall)), "computePctOfDevice": R(P(c("ku"), own("db"))), "copyUs": R(c("yu")), "copyPct": R(P(c("yu"), wall)), "hostCopyUs": R(c("hy")),
        "hostCopyPctOfHost": R(P(c("hy"), own("hb"))), "hostCopyPct": R(P(c("hy"), wall)), "d2hPerStepUs": per_step(c("d2h")), "h2dPerStepUs": per_step(c("h2d")), "hostScheduleUs": R(c("hs")), "hostSchedulePctOfHost": R(P(c("hs"), own("hb"))), "dispatchEventCount": c("disp"),
        "dispatchPerStep": per_step(c("disp"), 1), "hostSyncUs": R(c("su")), "hostSyncCount": c("sn"), "hostSyncPerStep": per_step(c("sn")), "hostExclusivePerStepUs": R(F.when(c("steps") > 0, c("h_only") / c("steps")).otherwise(c("h_only"))), "maxGapUs": R(c("gmax")),
        "maxGapPct": R(P(c("gmax"), wall)), "meanGapUs": R(F.when(c("gn") > 0, c("idle") / c("gn")).otherwise(0.0)), "gapCount": c("gn"), "avgStepUs": R(F.when(c("steps") > 0, wall / c("steps")).otherwise(wall)), "medianComputeUs": R(c("km")), "hasAttention": c("hasAttention"),
    }
    return x.select("scope", "phase", *(v.alias(k) for k, v in out.items()))


def settled(block: DataFrame) -> DataFrame:
    """The block computed once, as a table of one row for each scope: rules then read values, not the plan behind them."""
    return block.sparkSession.createDataFrame(block.collect(), block.schema)


def scores(override: dict | None = None) -> dict[str, Column]:
    """Score of each bottleneck over indicator columns (with ``mac`` and ``mte2``, null where unknown); ``override`` replaces limits."""
    sev, ok, c = (lambda v, r: S.severity(v, r, override)), (lambda v, r: S.passes(v, r, override)), F.col
    host = F.when(
        ok("hostOnlyPct", "hostOnlyGate") | ok("idlePct", "deviceIdleSupport"),
        45 * F.greatest(sev("hostOnlyPct", "hostOnlyGate"), sev("idlePct", "deviceIdleSupport"))
        + F.when(ok("dispatchPerStep", "dispatchPerStep") | ok("hostExclusivePerStepUs", "hostExclusivePerStepUs"), 35 * F.greatest(sev("dispatchPerStep", "dispatchPerStep"), sev("hostExclusivePerStepUs", "hostExclusivePerStepUs"))).otherwise(0.0)
        + F.when(c("hostBusyPct") > 0, 20 * sev("hostBusyPct", "hostBusyGate")).otherwise(0.0),
    )
    compute = F.when(
        ok("deviceBusyPct", "deviceBusyGate") & ok("computePct", "computeShareGate"),
        55 * F.greatest(sev("deviceBusyPct", "deviceBusyGate"), sev("computePct", "computeShareGate")) + F.when(ok("commExposedPct", "commExposedLow"), 25.0).otherwise(0.0)
        + F.when(ok("mac", "macRatioComputeBound"), 20.0).when(ok("mte2", "mte2RatioMemoryBound"), 12.0).otherwise(0.0),
    )
    comm = F.when(
        ok("commPctOfDevice", "commShareGate") & ok("commExposedPct", "commExposedGate"),
        55 * F.greatest(sev("commPctOfDevice", "commShareGate"), sev("commExposedPct", "commExposedGate"))
        + F.when(ok("commLatencyMedianUs", "commLatencyBoundUs"), 20.0).when(ok("commSizeMedianMb", "commBandwidthBoundMb"), 15.0).otherwise(0.0) + F.when(c("commOverlapPct") < 40, 15.0).otherwise(0.0),
    )
    copy = F.when(
        ok("copyPct", "copyShareGate") | ok("hostCopyPctOfHost", "hostCopyShareGate") | ok("d2hPerStepUs", "d2hPerStepUs"),
        45 * F.greatest(sev("copyPct", "copyShareGate"), sev("hostCopyPctOfHost", "hostCopyShareGate"), sev("d2hPerStepUs", "d2hPerStepUs"))
        + F.when(c("hostSyncCount") > 0, 12 * F.least(F.lit(1.0), c("hostSyncPerStep"))).otherwise(0.0) + F.when(ok("h2dPerStepUs", "d2hPerStepUs"), 10 * sev("h2dPerStepUs", "d2hPerStepUs")).otherwise(0.0),
    )
    clamp = lambda s: R(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.coalesce(s, F.lit(0.0)))), 1)
    return {"host": clamp(host), "compute": clamp(compute), "comm": clamp(comm), "copy": clamp(copy)}


def compute_subtype() -> Column:
    """What a device-bound scope is limited by."""
    gate = S.passes("deviceBusyPct", "deviceBusyGate") & S.passes("computePct", "computeShareGate")
    return F.when(gate & S.passes("mac", "macRatioComputeBound"), "compute-bound").when(gate & S.passes("mte2", "mte2RatioMemoryBound"), "memory-bound").when(gate & S.passes("mac", "lowUtilizationGate"), "low-efficiency")


def candidates(block: DataFrame, override: dict | None = None) -> DataFrame:
    """(scope, phase, bottleneck, score, place): all bottlenecks of each scope, best first; ties in the order host, compute, comm, copy."""
    s = scores(override)
    long = block.select("*", F.inline(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(k).alias("bottleneck"), v.alias("score")) for i, (k, v) in enumerate(s.items())))))
    return long.selectExpr("scope", "phase", "bottleneck", "score", "cast(row_number() over (partition by scope order by score desc, i) as int) as place")


def verdicts(block: DataFrame, trigger: float = rules.TRIGGER_SCORE, override: dict | None = None) -> DataFrame:
    """(scope, phase, bottleneck, score): the best of each scope, ``balanced`` below the trigger."""
    return candidates(block, override).where("place = 1").select("scope", "phase", F.when(F.col("score") >= trigger, F.col("bottleneck")).otherwise("balanced").alias("bottleneck"), "score")


def headline(block: DataFrame, trigger: float = rules.TRIGGER_SCORE, override: dict | None = None) -> DataFrame:
    """The scope and bottleneck with the highest score."""
    return verdicts(block, trigger, override).orderBy(F.desc("score"), "scope").limit(1)


#: Each gate beside its measure.
GATES = [
    ("hostOnlyGate", "hostOnlyPct"), ("deviceIdleSupport", "idlePct"), ("dispatchPerStep", "dispatchPerStep"), ("hostExclusivePerStepUs", "hostExclusivePerStepUs"), ("hostBusyGate", "hostBusyPct"), ("deviceBusyGate", "deviceBusyPct"), ("computeShareGate", "computePct"),
    ("commExposedLow", "commExposedPct"), ("commShareGate", "commPctOfDevice"), ("commExposedGate", "commExposedPct"), ("commLatencyBoundUs", "commLatencyMedianUs"), ("copyShareGate", "copyPct"), ("hostCopyShareGate", "hostCopyPctOfHost"), ("d2hPerStepUs", "d2hPerStepUs"),
]


def evidence(block: DataFrame, override: dict | None = None) -> DataFrame:
    """(scope, rule, metric, value, threshold, crossed, severity, text): each gate beside its measure."""
    rows = [
        F.struct(F.lit(r).alias("rule"), F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(S.threshold(r, override)[0]).alias("threshold"), S.passes(m, r, override).alias("crossed"), R(S.severity(m, r, override), 4).alias("severity"), S.describe(m, r, 1, override, rules.unit_of(m)).alias("text"))
        for r, m in GATES
    ]
    return block.select("scope", F.inline(F.array(*rows)))


def missing(block: DataFrame, override: dict | None = None) -> DataFrame:
    """(scope, rule, text): the gates that a scope does not reach, with what is lacking."""
    found = evidence(block, override).where("not crossed")
    return found.select("scope", "rule", F.concat("metric", F.lit(" "), F.coalesce(F.format_string("%.1f", "value"), F.lit("N/A")), F.lit(" does not reach "), F.format_string("%.1f", "threshold")).alias("text"))


def evidence_table(block: DataFrame) -> DataFrame:
    """(scope, place, group, metric, value, unit): the measures that a report shows of each scope."""
    rows = [(g, m) for g, ms in rules.EVIDENCE for m in ms]
    cells = [F.struct(F.lit(i).alias("place"), F.lit(g).alias("group"), F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(rules.unit_of(m)).alias("unit")) for i, (g, m) in enumerate(rows)]
    return block.select("scope", F.inline(F.array(*cells)))


def triggers(found: DataFrame, block: DataFrame) -> DataFrame:
    """(scope, cause, metric, value, unit): the measures behind each cause of ``causes``, by the bottleneck in its name."""
    cells = []
    for kind, ms in rules.TRIGGERS.items():
        cells += [F.when(F.expr(test or "true"), F.struct(F.lit(kind).alias("kind"), F.lit(m).alias("metric"), R(F.col(m).cast("double")).alias("value"), F.lit(rules.unit_of(m)).alias("unit"), F.col(m).isNull().alias("none"))) for m, test in ms]
    long = block.select("scope", F.inline(F.array_compact(F.array(*cells))))
    own = found.select("scope", "cause", F.substring_index("cause", ".", 1).alias("kind"))
    return own.join(long, ["scope", "kind"]).select("scope", "cause", "metric", F.when(~F.col("none"), F.col("value")).alias("value"), "unit")


def warnings(block: DataFrame, reached: DataFrame, sampled: bool = False) -> DataFrame:
    """(warning, detail) of a capture: what makes its conclusions less sure. ``reached`` are the scopes' candidates."""
    whole = block.where("scope = 'overall'")
    tests = [
        ("phases", "phaseConfidence = 'low'", "phases are told apart with low confidence"), ("sampling", str(sampled).lower(), "the trace is sampled"), ("steps", "stepCount <= 1", "a single step was found"), ("utilisation", "mac is null and mte2 is null", "no utilisation of operators"),
    ]
    own = whole.select(F.inline(F.array_compact(F.array(*(F.when(F.expr(f"coalesce({t}, false)"), F.struct(F.lit(w).alias("warning"), F.lit(d).alias("detail"))) for w, t, d in tests)))))
    none = reached.groupBy("scope").agg(F.max("score").alias("score")).where(F.col("score") < rules.TRIGGER_SCORE)
    none = none.agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("scope")), ", ").alias("detail")).where("n > 0").selectExpr("'no bottleneck' as warning", "detail")
    return own.unionByName(none)


def causes(block: DataFrame, trigger: float = rules.TRIGGER_SCORE, override: dict | None = None) -> DataFrame:
    """(scope, phase, bottleneck, cause): causes whose condition holds, for the bottlenecks that reach the trigger; ``<bottleneck>.generic`` if none does.

    A cause of one phase needs a scope of that phase; the scope of a whole capture carries its dominant one.
    """
    hit = candidates(block, override).where(F.col("score") >= trigger).select("scope", "bottleneck")
    tests = [F.when(F.expr(f"'{ph}' in ('both', phase) and ({test})"), F.struct(F.lit(i).alias("i"), F.lit(b).alias("bottleneck"), F.lit(c).alias("cause"))) for i, (c, b, ph, test) in enumerate(rules.CAUSES)]
    long = block.select("scope", "phase", F.explode(F.array_compact(F.array(*tests))).alias("x")).select("scope", "phase", "x.*")
    own = hit.join(long, ["scope", "bottleneck"], "left").join(block.select("scope", F.col("phase").alias("p")), "scope")
    return own.selectExpr("scope", "p as phase", "bottleneck", "coalesce(cause, concat(bottleneck, '.generic')) as cause")


def advice(block: DataFrame, trigger: float = rules.TRIGGER_SCORE, override: dict | None = None) -> DataFrame:
    """(scope, advice, bottleneck, level, gain_pct, low_pct, priority): advice whose condition holds, highest priority first in each scope."""
    score = candidates(block, override).select("scope", "bottleneck", "score")
    items = []
    for i, (a, b, ph, level, test, gain, low) in enumerate(rules.ADVICE):
        g = R(F.expr(f"cast({gain} as double)"), 1)
        w = R(F.expr(f"cast({low} as double)"), 1) if low else R(g * 0.5, 1)
        items.append(F.when(F.expr(f"'{ph}' in ('both', phase) and coalesce({test}, false)"), F.struct(F.lit(i).alias("i"), F.lit(a).alias("advice"), F.lit(b).alias("bottleneck"), F.lit(level).alias("level"), g.alias("gain_pct"), w.alias("low_pct"))))
    long = block.select("scope", F.explode(F.array_compact(F.array(*items))).alias("x")).select("scope", "x.*")
    out = long.join(score, ["scope", "bottleneck"], "left").where(f"bottleneck = 'balanced' or score >= {trigger}")
    return out.select("scope", "advice", "bottleneck", "level", "gain_pct", "low_pct", R(F.col("level") * 20 + F.least(F.lit(40.0), F.coalesce("score", F.lit(0.0)) * 0.4) + F.least(F.lit(20.0), F.col("gain_pct") * 0.4)).alias("priority"))


def merged_advice(found: DataFrame) -> DataFrame:
    """(advice, priority, gain_pct, low_pct, scopes): one row for each advice, the highest priority and all scopes."""
    return found.groupBy("advice").agg(F.max("priority").alias("priority"), F.max("gain_pct").alias("gain_pct"), F.max("low_pct").alias("low_pct"), F.array_join(F.array_sort(F.collect_set("scope")), ",").alias("scopes"))


def by_level(found: DataFrame) -> DataFrame:
    """(level, items): advice grouped by its level, highest first, each group by falling priority."""
    one = found.groupBy("advice").agg(F.max("level").alias("level"), F.max("priority").alias("priority"))
    return one.groupBy("level").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("priority")).alias("p"), "advice"))), lambda x: x["advice"]).alias("items"))


def top_actions(found: DataFrame, bottleneck: str | None = None, n: int = 3) -> DataFrame:
    """The ``n`` advice items of highest priority, of one bottleneck if it is named."""
    own = found if bottleneck is None else found.where(F.col("bottleneck") == bottleneck)
    return merged_advice(own).orderBy(F.desc("priority"), "advice").limit(n)


def combined_gains(found: DataFrame) -> DataFrame:
    """One row: items with a gain, capped sums of expected (70) and careful (50) gains."""
    return merged_advice(found).where("gain_pct > 0").agg(F.count("*").alias("items"), R(F.least(F.lit(70.0), F.coalesce(F.sum("gain_pct"), F.lit(0.0))), 1).alias("optimistic_pct"), R(F.least(F.lit(50.0), F.coalesce(F.sum("low_pct"), F.lit(0.0))), 1).alias("conservative_pct"))


# --- comparison of two captures -------------------------------------------------------------------------------------------


def described_metrics(spark) -> DataFrame:
    """(metric, label, unit, direction, group) of all compared metrics, in report order."""
    return spark.createDataFrame([(m, *rules.METRIC_TEXT[m][:1], rules.unit_of(m), d, rules.METRIC_TEXT[m][1]) for m, d in rules.METRICS], "metric string, label string, unit string, direction string, group string")


def compared_metrics(before: DataFrame, after: DataFrame) -> DataFrame:
    """(metric, before, after, delta_abs, delta_pct, improvement_pct, direction, improved) of two one-row indicator blocks."""
    rows = lambda block, name: block.select(F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.lit(d).alias("direction"), F.col(m).cast("double").alias(name)) for m, d in rules.METRICS))))
    both = rows(before, "before").join(rows(after, "after").select("metric", "after"), "metric").withColumn("raw", S.rel_pct("before", "after"))
    known = lambda v, digits=1: F.when(v.isNotNull(), R(v, digits))
    return both.select("metric", "before", "after", known(F.col("after") - F.col("before"), 2).alias("delta_abs"), known(F.col("raw")).alias("delta_pct"), known(S.improvement_pct("raw", "direction")).alias("improvement_pct"), "direction", S.judged("raw", "direction").alias("improved"))


def compared_operators(before: DataFrame, after: DataFrame, noise_us: int = 1) -> DataFrame:
    """(name, before_us, after_us, delta_us, verdict) of operators by name; missing ones count as 0, nothing on both sides goes."""
    b, a = before.groupBy("name").agg(F.sum("total_us").alias("before_us")), after.groupBy(F.col("name").alias("__n")).agg(F.sum("total_us").alias("after_us"))
    both = b.join(a, b["name"] == a["__n"], "full_outer").selectExpr("coalesce(name, __n) as name", "coalesce(before_us, 0) as before_us", "coalesce(after_us, 0) as after_us").where("before_us <> 0 or after_us <> 0")
    return both.selectExpr("*", "after_us - before_us as delta_us", f"case when after_us - before_us < -{noise_us} then 'improved' when after_us - before_us > {noise_us} then 'regressed' else 'unchanged' end as verdict")


def verified_advice(found: DataFrame, metrics: DataFrame, later: DataFrame | None = None) -> DataFrame:
    """(advice, metric, expected_pct, observed_pct, threshold_pct, verdict, still_recommended): what became of merged advice.

    The first target metric of each advice decides: achieved from the threshold on, partial above 0, else missed; unknown without a
    target or a comparable value. ``later`` is the merged advice of the second capture.
    """
    spark = found.sparkSession
    targets = spark.createDataFrame([(a, ms[0]) for a, ms in rules.ADVICE_TARGETS.items() if ms], "advice string, metric string")
    each = found.select("advice", F.col("gain_pct").alias("expected_pct")).join(F.broadcast(targets), "advice", "left")
    each = each.join(metrics.select("metric", F.col("improvement_pct").alias("observed_pct")), "metric", "left")
    still = F.lit(False) if later is None else F.col("__still").isNotNull()
    if later is not None:
        each = each.join(later.select(F.col("advice").alias("__still")).distinct(), F.col("advice") == F.col("__still"), "left")
    limit = F.when(F.col("expected_pct").isNotNull(), S.acceptance_threshold("expected_pct"))
    seen, unknown = F.col("observed_pct"), F.col("advice").isin(rules.CONFIDENCE_ADVICE)
    verdict = F.when(unknown | seen.isNull(), "unknown").when(seen >= F.coalesce(limit, F.lit(1.0)), "achieved").when(seen > 0, "partial").otherwise("missed")
    return each.select("advice", "metric", "expected_pct", "observed_pct", limit.alias("threshold_pct"), verdict.alias("verdict"), still.alias("still_recommended"))


#: Checks of comparability: (name, whether it lowers the level, condition over both sides with a missing value as no difference).
CHECKS = [
    ("steps", True, "abs({steps}) > 15"), ("mix", True, "exists(array_union(map_keys(b_mix), map_keys(a_mix)), k -> abs(coalesce(b_mix[k], 0) - coalesce(a_mix[k], 0)) > 10)"), ("override", True, "b_override <> a_override"), ("sampled", True, "b_sampled or a_sampled"),
    ("source", False, "not (b_source <=> a_source)"), ("files", True, "size(array_except(b_files, a_files)) + size(array_except(a_files, b_files)) > 0"), ("bottleneck", False, "b_bottleneck <> a_bottleneck"), ("window", False, "abs({wall_us}) > 20"),
]


def comparability(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: for each check whether it speaks against comparing two captures, the number of those that warn, the level.

    Both sides are one row: steps, wall_us, mix (phase -> share of the window in percent), override, sampled, source, files (names),
    bottleneck. The level is high without a warning, medium with one, else low; checks that only inform do not lower it.
    """
    b, a = before.select(*(F.col(c).alias(f"b_{c}") for c in before.columns)), after.select(*(F.col(c).alias(f"a_{c}") for c in after.columns))
    change = {c: f"case when b_{c} = 0 then case when a_{c} = 0 then 0 end else (a_{c} - b_{c}) / abs(b_{c}) * 100 end" for c in ("steps", "wall_us")}
    x = b.join(F.broadcast(a)).selectExpr(*(f"coalesce({t.format(**change)}, false) as differs_{k}" for k, _, t in CHECKS))
    warn = " + ".join(f"int(differs_{k})" for k, warns, _ in CHECKS if warns)
    return x.selectExpr("*", f"{warn} as warnings", f"case when {warn} = 0 then 'high' when {warn} = 1 then 'medium' else 'low' end as level")


def comparison_warnings(checks: DataFrame, metrics: DataFrame, verified: DataFrame) -> DataFrame:
    """(warning, detail) of a comparison: checks that warn, another bottleneck, shares that went the wrong way, missed advice."""
    told = [k for k, warns, _ in CHECKS if warns or k == "bottleneck"]
    own = checks.select(F.explode(F.array_compact(F.array(*(F.when(F.col(f"differs_{k}"), F.lit(k)) for k in told)))).alias("warning")).selectExpr("warning", "'' as detail")
    shares = [m for m, d in rules.METRICS if rules.unit_of(m) == "%" and d != "neutral"]
    listed = lambda rows, column, name: rows.agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(column)), ", ").alias("detail")).where("n > 0").selectExpr(f"'{name}' as warning", "detail")
    turned = listed(metrics.where(F.col("metric").isin(shares) & (F.col("improvement_pct") < 0)), "metric", "reversed shares")
    return own.unionByName(turned).unionByName(listed(verified.where("verdict = 'missed'"), "advice", "missed advice"))


def comparison_headline(metrics: DataFrame, verified: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: step, busy, host and dispatch changes, whether the bottleneck changed, counts of advice verdicts, and a sentence.

    ``before`` and ``after`` are the headline rows (bottleneck, score) of both sides.
    """
    keys = ["avgStepUs", "deviceBusyPct", "hostExclusivePerStepUs", "dispatchPerStep"]
    pick = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    m = metrics.where(F.col("metric").isin(keys)).agg(
        pick(keys[0], "before").alias("step_before_us"), pick(keys[0], "after").alias("step_after_us"), pick(keys[0], "delta_pct").alias("step_pct"), pick(keys[0], "improved").alias("step_improved"), pick(keys[1], "before").alias("busy_before_pct"), pick(keys[1], "after").alias("busy_after_pct"),
        pick(keys[1], "delta_abs").alias("busy_delta_pts"), pick(keys[2], "improvement_pct").alias("host_exclusive_pct"), pick(keys[3], "improvement_pct").alias("dispatch_pct"),
    )
    v = verified.agg(*(F.count_if(F.col("verdict") == k).alias(k) for k in ("achieved", "missed", "unknown")))
    sides = before.select(F.col("bottleneck").alias("b0"), F.col("score").alias("s0")).join(F.broadcast(after.select(F.col("bottleneck").alias("b1"), F.col("score").alias("s1"))))
    x = m.join(F.broadcast(v)).join(F.broadcast(sides)).withColumn("bottleneck_changed", F.expr("b0 <> b1"))
    moved = lambda c, name: f"case when abs({c}) > {rules.NOISE_PCT} then concat('{name} ', if({c} > 0, 'down ', 'up '), format_string('%.1f', abs({c})), '%') end"
    parts = [
        "case when step_pct is not null then concat('step ', if(step_pct < 0, 'down ', 'up '), format_string('%.1f', abs(step_pct)), '%') end", "concat('device busy ', format_string('%.2f', busy_before_pct), '% to ', format_string('%.2f', busy_after_pct), '%')",
        moved("host_exclusive_pct", "host alone per step"), moved("dispatch_pct", "dispatches per step"), "case when achieved > 0 then concat(achieved, ' advice items achieved') end",
        "if(bottleneck_changed, concat('bottleneck ', b0, ' to ', b1), concat('bottleneck still ', b1, ', ', format_string('%.0f', s0), ' to ', format_string('%.0f', s1)))",
    ]
    return x.withColumn("summary", F.expr(f"concat_ws('; ', {', '.join(parts)})")).drop("b0", "b1", "s0", "s1")
