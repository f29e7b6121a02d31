"""Interval algebra: union, overlap, exclusive time, islands and gaps of large interval sets.

A running maximum over all intervals in order would be one task. Instead the time axis is cut into parts: an interval is clipped to
each part that it touches, every part is solved on its own, lengths add up exactly, and islands that touch an edge are joined across
it (at most two for each part and key, whatever the number of intervals).
The borders of the parts are quantiles of the starts, from a sketch that is merged over all tasks: each part has about as many
starts, however they crowd on the axis. An instant at which more start than a part holds cannot be cut; intervals with the same start
are folded into one before they are shuffled.
Other ordered passes (next, last before, running sums) work alike: each part in its own task, then one row a part, in order,
carries what the parts before it hand on. Times are whole numbers (microseconds). Intervals with an end before their start, or nulls, are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts of the time axis, at least; a session with more shuffle partitions gets as many parts.
BUCKETS = 64
#: Beyond all times.
FAR = 1 << 62


def parts_of(df: DataFrame, buckets: int | None) -> int:
    """Number of parts: the one asked for, else by the session."""
    return buckets or max(BUCKETS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def cuts_of(df: DataFrame, at: str, buckets: int | None = None) -> DataFrame:
    """One row with ``__cuts``: rising borders that divide the values of ``at`` into about equal parts, by a mergeable quantile sketch.

    Without values there are none, and all is one part.
    """
    n = parts_of(df, buckets)
    shares = ", ".join(f"{k / n!r}D" for k in range(1, n))
    return df.agg(F.expr(f"coalesce(array_sort(array_distinct(percentile_approx(cast(`{at}` as bigint), array({shares}), {20 * n}))), cast(array() as array<bigint>)) as __cuts" if n > 1 else "cast(array() as array<bigint>) as __cuts"))


def part_of(x: str, n: int) -> str:
    """SQL of the part that the time ``x`` stands in: the number of borders at or before it, by binary search over fewer than ``n``."""
    steps = ", ".join(str(1 << k) for k in reversed(range(max(1, n.bit_length()))))
    return f"aggregate(array({steps}), 0, (__p, __w) -> if(__p + __w <= size(__cuts) and get(__cuts, __p + __w - 1) <= {x}, __p + __w, __p))"


def in_parts(df: DataFrame, at: str, cuts: DataFrame | None = None, buckets: int | None = None) -> DataFrame:
    """``df`` with ``__part``, the part of the axis of ``at`` that a row stands in; ``cuts`` is a row of ``cuts_of``, by default that of ``df``."""
    cuts = cuts_of(df, at, buckets) if cuts is None else cuts
    return df.join(F.broadcast(cuts)).selectExpr(*(f"`{c}`" for c in df.columns), f"{part_of(f'`{at}`', parts_of(df, buckets))} as __part")


def with_earlier(rows: DataFrame, one: str, carry: str, name: str, keys: list[str] | None = None) -> DataFrame:
    """``rows`` (with ``__part``) and ``name``: what the parts before a row's own hand on.

    ``one`` aggregates a part to ``__v``, ``carry`` folds the ``__v`` of all earlier parts: one row for each part and key.
    """
    keys = keys or []
    own = rows.groupBy(*keys, "__part").agg(F.expr(one).alias("__v"))
    by = f"partition by {', '.join(f'`{k}`' for k in keys)} " if keys else ""
    own = own.selectExpr(*(f"`{k}` as `__q_{k}`" for k in keys), "__part as __q", f"{carry} over ({by}order by __part rows between unbounded preceding and 1 preceding) as `{name}`")
    on = rows["__part"].eqNullSafe(own["__q"])
    for k in keys:
        on = on & rows[k].eqNullSafe(own[f"__q_{k}"])
    return rows.join(own if keys else F.broadcast(own), on).drop("__q", *(f"__q_{k}" for k in keys))  # without keys: a row for each part


def _clipped(df: DataFrame, keys: list[str], start: str, end: str, buckets: int | None, extra: list[str] | None = None) -> DataFrame:
    """keys, extra, part, s, e, lo, hi: each interval clipped to each part [lo, hi) of the axis that it touches."""
    extra = extra or []
    src = df.where(f"`{end}` >= `{start}`").selectExpr(*(f"`{k}`" for k in [*keys, *extra]), f"cast(`{start}` as bigint) as s", f"cast(`{end}` as bigint) as e")
    n = parts_of(df, buckets)
    cut = src.join(F.broadcast(cuts_of(src, "s", buckets)))  # one row
    cut = cut.selectExpr("*", f"explode(sequence({part_of('s', n)}, {part_of('greatest(s, e - 1)', n)})) as part")
    cut = cut.selectExpr("*", f"if(part = 0, {-FAR}L, get(__cuts, part - 1)) as lo", f"if(part = size(__cuts), {FAR}L, get(__cuts, part)) as hi")
    return cut.selectExpr(*(f"`{k}`" for k in [*keys, *extra]), "part", "greatest(s, lo) as s", "least(e, hi) as e", "lo", "hi")


def islands(df: DataFrame, keys: list[str] | None = None, start: str = "start", end: str = "end", buckets: int | None = None) -> DataFrame:
    """(keys, start, end, n): maximal merged intervals; touching ones merge. ``n`` counts clipped pieces in it."""
    keys = keys or []
    by = ", ".join(f"`{k}`" for k in [*keys, "part"])
    cut = _clipped(df, keys, start, end, buckets).groupBy(*keys, "part", "lo", "hi", "s").agg(F.max("e").alias("e"), F.count("*").alias("c"))  # same start: one row
    top = cut.selectExpr("*", f"max(e) over (partition by {by} order by s, e rows between unbounded preceding and 1 preceding) as m")
    flag = top.selectExpr("*", f"sum(case when m is null or s > m then 1 else 0 end) over (partition by {by} order by s, e rows unbounded preceding) as g")
    pieces = flag.groupBy(*keys, "part", "g", "lo", "hi").agg(F.min("s").alias("start"), F.max("e").alias("end"), F.sum("c").alias("n"))
    inner = pieces.where("start > lo and end < hi").select(*keys, "start", "end", "n")
    edge = pieces.where("start <= lo or end >= hi")
    over = f"over (partition by {', '.join(f'`{k}`' for k in keys)} order by start" if keys else "over (order by start"  # at most two rows for each part and key
    edge = edge.selectExpr("*", f"lag(end) {over}) as m").selectExpr("*", f"sum(case when m is null or start > m then 1 else 0 end) {over} rows unbounded preceding) as j")
    joined = edge.groupBy(*keys, "j").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n")).select(*keys, "start", "end", "n")
    return inner.unionByName(joined)


def union_length(df: DataFrame, keys: list[str] | None = None, start: str = "start", end: str = "end", buckets: int | None = None) -> DataFrame:
    """(keys, length): length of the union of the intervals."""
    found = islands(df, keys, start, end, buckets)
    return found.groupBy(*(keys or [])).agg(F.coalesce(F.sum(F.expr("`end` - `start`")), F.lit(0)).cast("long").alias("length"))


def session_islands(df: DataFrame, keys: list[str], ts: str, dur: str) -> DataFrame:
    """(keys, start, end) by ``session_window`` with each interval's own length as its gap; intervals of length 0 are ignored.

    Merges partly before the shuffle; works on streams as well.
    """
    micro = df.where(f"`{dur}` > 0").selectExpr(*(f"`{k}`" for k in keys), f"timestamp_micros(`{ts}`) as t", f"make_interval(0, 0, 0, 0, 0, 0, cast(`{dur}` / 1000000 as decimal(18, 6))) as d")
    out = micro.groupBy(*keys, F.expr("session_window(t, d)").alias("w")).count()
    return out.selectExpr(*(f"`{k}`" for k in keys), "unix_micros(w.start) as start", "unix_micros(w.end) as end")


def sweeps(df: DataFrame, sets: dict[str, str], measures: dict[str, str], keys: list[str] | None = None, start: str = "start", end: str = "end", buckets: int | None = None) -> DataFrame:
    """(keys, measures): one pass over the ends of several sets of intervals.

    ``sets`` names conditions on rows; ``measures`` are conditions on how many intervals of each set are open, and give the length of
    time for which they hold, 0 if none. Rows in no set are not looked at.
    """
    keys, k = keys or [], [f"`{c}`" for c in keys or []]
    flagged = df.selectExpr(*k, f"`{start}`", f"`{end}`", *(f"int(coalesce({t}, false)) as `{n}`" for n, t in sets.items())).where(" or ".join(f"`{n}` = 1" for n in sets))
    cut = _clipped(flagged, keys, start, end, buckets, list(sets)).where("e > s")
    marks = cut.selectExpr(*k, "part", *(f"`{n}`" for n in sets), "inline(array(named_struct('t', s, '__d', 1), named_struct('t', e, '__d', -1)))")
    steps = marks.groupBy(*keys, "part", "t").agg(*(F.sum(F.expr(f"`{n}` * __d")).alias(n) for n in sets))
    over = f"over (partition by {', '.join([*k, 'part'])} order by t)"
    run = steps.selectExpr(*k, *(f"sum(`{n}`) {over} as `{n}`" for n in sets), f"lead(t) {over} - t as __len")
    return run.groupBy(*keys).agg(*(F.coalesce(F.sum(F.expr(f"case when {t} then __len end")), F.lit(0)).cast("long").alias(n) for n, t in measures.items()))


def sweeps_in(df: DataFrame, scopes: list[tuple[str, int, int]], sets: dict[str, str], measures: dict[str, str], idle: str, least: int = 0, start: str = "start", end: str = "end", buckets: int | None = None) -> DataFrame:
    """(scope, measures, idle, longest, pauses): ``sweeps`` and the gaps of one set for several scopes, which may overlap, in one pass.

    ``scopes`` are a few (name, ws, we); an interval belongs to those in which it starts, whole. No row is copied for a scope: each
    change of what is open is one row with a counter for each scope and set, and measures and gaps are folded from the same rows.
    ``pauses`` spans of the scope without an interval of the set ``idle`` are longer than ``least``: ``idle`` in total, ``longest`` each.
    """
    scoped = list(enumerate(scopes))
    inside = [f"int(coalesce(`{start}` >= {a}L and `{start}` < {b}L, false)) as `__m{i}`" for i, (_, a, b) in scoped]
    rows = df.selectExpr(f"`{start}`", f"`{end}`", *(f"int(coalesce({t}, false)) as `{n}`" for n, t in sets.items()), *inside)
    rows = rows.where(" or ".join(f"`{n}` = 1" for n in sets)).where(" or ".join(f"`__m{i}` = 1" for i, _ in scoped))
    cut = _clipped(rows, [], start, end, buckets, [*sets, *(f"__m{i}" for i, _ in scoped)])
    marks = cut.selectExpr("part", *(f"`{n}`" for n in sets), *(f"`__m{i}`" for i, _ in scoped), "inline(array(named_struct('t', s, '__d', 1), named_struct('t', e, '__d', -1)))")
    steps = marks.groupBy("part", "t").agg(
        *(F.expr(f"sum(`{n}` * `__m{i}` * __d)").alias(f"{n}_{i}") for i, _ in scoped for n in sets), *(F.expr(f"sum(if(__d > 0, `{idle}` * `__m{i}`, 0))").alias(f"__o{i}") for i, _ in scoped)
    )
    over = "over (partition by part order by t)"
    run = steps.selectExpr("part", "t", f"lead(t) {over} - t as __len", *(f"sum(`{n}_{i}`) {over} as `{n}_{i}`" for i, _ in scoped for n in sets), *(f"`{idle}_{i}` as `__x{i}`" for i, _ in scoped), *(f"`__o{i}`" for i, _ in scoped))
    begins = {i: f"(`__o{i}` > 0 and `{idle}_{i}` = `__x{i}`)" for i, _ in scoped}  # an interval starts and none was open before
    ends = {i: f"(`{idle}_{i}` = 0 and (`__x{i}` < 0 or `__o{i}` > 0))" for i, _ in scoped}  # none is open any more
    run = run.selectExpr("*", *(f"max(case when {ends[i]} then t end) over (partition by part order by t rows between unbounded preceding and 1 preceding) as `__l{i}`" for i, _ in scoped))
    held = {n: [re.sub(rf"\b({'|'.join(sets)})\b", rf"`\1_{i}`", t) for i, _ in scoped] for n, t in measures.items()}
    pause = {i: f"case when {begins[i]} and t - `__l{i}` > {least} then t - `__l{i}` end" for i, _ in scoped}
    each = run.groupBy("part").agg(
        *(F.expr(f"sum(case when {t} then __len end)").alias(f"{n}_{i}") for n, ts in held.items() for i, t in enumerate(ts)),
        *(F.expr(f"{f}({x})").alias(f"__{f}{i}") for f in ("sum", "max", "count") for i, x in pause.items()), *(F.expr(f"min(case when {begins[i]} then t end)").alias(f"__f{i}") for i, _ in scoped), *(F.expr(f"max(case when {ends[i]} then t end)").alias(f"__l{i}") for i, _ in scoped),
    )
    between = each.selectExpr("*", *(f"`__f{i}` - coalesce(max(`__l{i}`) over (order by part rows between unbounded preceding and 1 preceding), {a}L) as `__g{i}`" for i, (_, a, _) in scoped))  # a row a part
    cells = []
    for i, (name, a, b) in scoped:
        last = f"({b}L - coalesce(max(`__l{i}`), {a}L))"
        own = f"case when `__g{i}` > {least} then `__g{i}` end"
        at_end = f"if({last} > {least}, {{0}}, 0L)"
        sums = ", ".join(f"'{n}', cast(coalesce(sum(`{n}_{i}`), 0) as bigint)" for n in measures)
        cells.append(
            f"named_struct('scope', '{name}', {sums}, 'idle', cast(coalesce(sum(`__sum{i}`), 0) + coalesce(sum({own}), 0) + {at_end.format(last)} as bigint), "
            f"'longest', cast(greatest(coalesce(max(`__max{i}`), 0), coalesce(max({own}), 0), {at_end.format(last)}) as bigint), 'pauses', cast(coalesce(sum(`__count{i}`), 0) + count({own}) + {at_end.format('1L')} as bigint))"
        )
    return between.agg(F.expr(f"array({', '.join(cells)})").alias("__s")).selectExpr("inline(__s)")


def sweep(df: DataFrame, side: str, left: str, right: str, keys: list[str] | None = None, start: str = "start", end: str = "end", buckets: int | None = None) -> DataFrame:
    """(keys, left_us, right_us, both_us, left_only_us, right_only_us): one pass over the ends of two sets of intervals."""
    measures = {"left_us": "l > 0", "right_us": "r > 0", "both_us": "l > 0 and r > 0", "left_only_us": "l > 0 and r = 0", "right_only_us": "r > 0 and l = 0"}
    return sweeps(df, {"l": f"`{side}` = '{left}'", "r": f"`{side}` = '{right}'"}, measures, keys, start, end, buckets)


def gaps(busy: DataFrame, window: DataFrame, least: int = 0, keys: list[str] | None = None, start: str = "start", end: str = "end", buckets: int | None = None) -> DataFrame:
    """(keys, start, end, dur): idle spans of ``window(keys, ws, we)`` longer than ``least``; without busy intervals the whole window.

    Neighbours are found inside each part of the axis; what remains, between parts, are two rows for each part and key.
    """
    keys = keys or []
    named = [f"`{k}`" for k in keys]
    merged = islands(busy, keys, start, end, buckets).select(*keys, "start", "end")
    edges = window.selectExpr(*named, "ws as start", "ws as end").unionByName(window.selectExpr(*named, "we as start", "we as end"))
    rows = in_parts(merged.unionByName(edges), "start", cuts_of(busy, start, buckets), buckets)
    over = f"over (partition by {', '.join([*named, '__part'])} order by start, end)"
    run = rows.selectExpr(*named, "__part", "start", "end", f"lead(start) {over} as __n", f"row_number() {over} as __r")
    inner = run.where("__n is not null").selectExpr(*named, "end as s", "__n as e")
    ends = run.where("__n is null or __r = 1").groupBy(*keys, "__part").agg(F.min("start").alias("first"), F.expr("max_by(`end`, struct(start, `end`))").alias("last"))
    across = ends.selectExpr(*named, "last as s", f"lead(first) over ({f'partition by {", ".join(named)} ' if keys else ''}order by __part) as e")
    found = inner.unionByName(across)
    return found.where(f"e - s > {least}").selectExpr(*named, "s as start", "e as end", "e - s as dur")


def as_of(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, value: str, keys: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """``left`` with the ``value`` of the last ``right`` row at or before ``left_ts`` (per key): union, then one ordered pass.

    Of values at one time the largest counts. Null times match nothing; null values are passed over.
    """
    keys = keys or []
    names = left.columns
    right = right.where(F.col(right_ts).isNotNull() & F.col(value).isNotNull())
    a = left.select(*(F.col(c) for c in names), F.col(left_ts).alias("__t"), F.lit(1).alias("__k"), F.lit(None).cast(right.schema[value].dataType).alias("__v"))
    b = right.select(*(F.col(c) if c in keys else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in names), F.col(right_ts).alias("__t"), F.lit(0).alias("__k"), F.col(value).alias("__v"))
    times = left.select(F.col(left_ts).alias("t")).unionByName(right.select(F.col(right_ts).alias("t")))
    rows = in_parts(a.unionByName(b).withColumnRenamed("__v", "__w"), "__t", cuts_of(times, "t", buckets), buckets)
    by = ", ".join([*(f"`{k}`" for k in keys), "__part"])
    both = rows.selectExpr("*", f"last_value(__w) ignore nulls over (partition by {by} order by __t, __k, __w rows unbounded preceding) as __own")
    both = with_earlier(both, "max_by(__w, case when __w is not null then struct(__t, __w) end)", "last_value(__v) ignore nulls", "__earlier", keys)
    return both.where("__k = 1").selectExpr(*(f"`{c}`" for c in names), f"case when __t is not null then coalesce(__own, __earlier) end as `{value}_asof`")


#: A step goes to that many aligned blocks, up to four times as many (and one more at its end).
BLOCKS = 16


def contained(events: DataFrame, steps: DataFrame, ts: str = "start", blocks: int = BLOCKS) -> DataFrame:
    """``events`` with the step (``step, ws, we`` of ``steps``) in which they start, ``ws <= ts < we``; events in none go.

    A range join as an equi-join on aligned dyadic blocks. A step is covered by blocks of one size, a power of four that its own length
    decides (``blocks`` to four times as many), so steps of microseconds and of hours are cut alike, whether they follow each other, nest or
    overlap. An event has one key for each size in use: steps of about one length give a single one, any lengths thirty-two at most.
    Blocks at the ends of a step reach beyond it by a sixteenth of it at most; the times decide there. Empty steps, null times and events
    outside all steps match nothing. A block with very many events is split by the adaptive skew join.
    """
    own = steps.where("we > ws").selectExpr("step", "cast(ws as bigint) as ws", "cast(we as bigint) as we", f"greatest(0, length(bin(cast(we - ws as bigint))) - {blocks.bit_length()}) div 2 * 2 as __l")
    sizes = own.agg(F.collect_set(F.col("__l").cast("int")).alias("__ls"))  # thirty-two at most
    cut = own.selectExpr("step", "ws", "we", "cast(__l as int) as __l").selectExpr("step", "ws", "we", "__l", "explode(sequence(shiftright(ws, __l), shiftright(we - 1, __l))) as __b")
    keyed = events.join(F.broadcast(sizes)).selectExpr(*(f"`{c}`" for c in events.columns), "explode(__ls) as __l").withColumn("__b", F.expr(f"shiftright(cast(`{ts}` as bigint), __l)"))
    return keyed.join(cut, ["__l", "__b"]).where(f"`{ts}` >= ws and `{ts}` < we").drop("__l", "__b", "ws", "we")
