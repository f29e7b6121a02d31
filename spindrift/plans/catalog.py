"""Catalogue of the profiling queries: name -> plan, and the SQL that each must equal, written independently of the plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions import scalars as S
from spindrift.functions.tables import kept
from spindrift.operators import analysis as A
from spindrift.operators import dataset as D
from spindrift.operators import intervals as I  # noqa: E741
from spindrift.operators import phases as P
from spindrift.plans import adapters
from spindrift.plans.adapters import EV, INST, STEPS, events, instances, steps, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
DAY = 86_400_000_000


def query(name: str, oracle: str | None = None):
    def register(plan):
        QUERIES[name] = plan
        if oracle is not None:
            ORACLES[name] = oracle
        return plan

    return register


def js(x: str, digits: int = 2) -> str:
    """Oracle's half-up rounding of a double; null counts as 0."""
    u = 10**digits
    return f"coalesce(floor(CAST({x} AS DOUBLE) * {u}.0 + 0.5) / {u}.0, 0.0)"


def pct(a: str, b: str) -> str:
    """Oracle's percentage."""
    return f"(CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} * 100 ELSE 0.0 END)"


def isl(src: str, keys: str = "", name: str = "isl") -> str:
    """Oracle's islands of ``src`` (ts, te and ``keys``) as common table expressions."""
    by = f"PARTITION BY {keys} " if keys else ""
    k = f"{keys}, " if keys else ""
    return f"""{name}_a AS (SELECT {k}ts, te, max(te) OVER ({by}ORDER BY ts, te ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM {src}),
{name}_b AS (SELECT *, sum(CASE WHEN m IS NULL OR ts > m THEN 1 ELSE 0 END) OVER ({by}ORDER BY ts, te ROWS UNBOUNDED PRECEDING) AS g FROM {name}_a),
{name} AS (SELECT {k}min(ts) AS s, max(te) AS e FROM {name}_b GROUP BY {k}g)"""


def swp(src: str, side: str, left: str, right: str, keys: str = "", name: str = "swp") -> str:
    """Oracle's sweep of two sides of ``src``."""
    by = f"PARTITION BY {keys} " if keys else ""
    k = f"{keys}, " if keys else ""
    return f"""{name}_m AS (SELECT {k}ts AS t, CASE WHEN {side} = '{left}' THEN 1 ELSE 0 END AS l, CASE WHEN {side} = '{right}' THEN 1 ELSE 0 END AS r FROM {src} WHERE {side} IN ('{left}', '{right}')
  UNION ALL SELECT {k}te, CASE WHEN {side} = '{left}' THEN -1 ELSE 0 END, CASE WHEN {side} = '{right}' THEN -1 ELSE 0 END FROM {src} WHERE {side} IN ('{left}', '{right}')),
{name}_s AS (SELECT {k}t, sum(l) AS l, sum(r) AS r FROM {name}_m GROUP BY {k}t),
{name}_r AS (SELECT {k}sum(l) OVER ({by}ORDER BY t) AS l, sum(r) OVER ({by}ORDER BY t) AS r, lead(t) OVER ({by}ORDER BY t) - t AS len FROM {name}_s),
{name} AS (SELECT {k}CAST(coalesce(sum(len) FILTER (WHERE l > 0), 0) AS BIGINT) AS left_us, CAST(coalesce(sum(len) FILTER (WHERE r > 0), 0) AS BIGINT) AS right_us, CAST(coalesce(sum(len) FILTER (WHERE l > 0 AND r > 0), 0) AS BIGINT) AS both_us,
  CAST(coalesce(sum(len) FILTER (WHERE l > 0 AND r = 0), 0) AS BIGINT) AS left_only_us, CAST(coalesce(sum(len) FILTER (WHERE r > 0 AND l = 0), 0) AS BIGINT) AS right_only_us FROM {name}_r {'GROUP BY ' + keys if keys else ''})"""


# --- interval algebra -------------------------------------------------------------------------------------------------------

_BUSY = f"{EV}, {isl('ev', 'device')} SELECT device, CAST(sum(e - s) AS BIGINT) AS busy_us, count(*) AS islands FROM isl GROUP BY device"


@query("interval_union_busy", _BUSY)
def interval_union_busy(spark, d):
    return I.islands(events(spark, d), ["device"], "ts", "te").groupBy("device").agg(F.sum(F.expr("`end` - `start`")).alias("busy_us"), F.count("*").alias("islands"))


@query("interval_union_session", _BUSY)
def interval_union_session(spark, d):
    return I.session_islands(events(spark, d), ["device"], "ts", "dur").groupBy("device").agg(F.sum(F.expr("`end` - `start`")).alias("busy_us"), F.count("*").alias("islands"))


@query("interval_overlap", f"{EV}, {swp('ev', 'device', 'device', 'host')} SELECT both_us FROM swp")
def interval_overlap(spark, d):
    return I.sweep(events(spark, d), "device", "device", "host", [], "ts", "te").select("both_us")


@query("host_exclusive", f"{EV}, {swp('ev', 'device', 'device', 'host')} SELECT left_us AS device_busy_us, right_us AS host_busy_us, both_us AS overlap_us, right_only_us AS host_exclusive_us, left_only_us AS device_exclusive_us FROM swp")
def host_exclusive(spark, d):
    return I.sweep(events(spark, d), "device", "device", "host", [], "ts", "te").selectExpr("left_us as device_busy_us", "right_us as host_busy_us", "both_us as overlap_us", "right_only_us as host_exclusive_us", "left_only_us as device_exclusive_us")


_GAPS = f"""{EV}, dv AS (SELECT * FROM ev WHERE device = 'device'), {isl('dv')}, pts AS (SELECT s, e FROM isl UNION ALL SELECT min(ts), min(ts) FROM ev UNION ALL SELECT max(te), max(te) FROM ev),
gap AS (SELECT gap_start, gap_end, gap_end - gap_start AS dur FROM (SELECT e AS gap_start, lead(s) OVER (ORDER BY s, e) AS gap_end FROM pts) WHERE gap_end - gap_start > 50)"""


def _gaps(spark, d):
    ev = events(spark, d)
    return ev, I.gaps(ev.where("device = 'device'"), D.window_of(ev), 50, [], "ts", "te").selectExpr("start as gap_start", "`end` as gap_end", "dur")


@query("device_gaps", f"{_GAPS} SELECT * FROM gap")
def device_gaps(spark, d):
    return _gaps(spark, d)[1]


@query("gap_stats", f"{_GAPS} SELECT CAST(sum(dur) AS BIGINT) AS total_us, max(dur) AS max_us, count(*) AS gaps, {js('sum(dur) / count(*)')} AS mean_us FROM gap")
def gap_stats(spark, d):
    return _gaps(spark, d)[1].agg(F.sum("dur").alias("total_us"), F.max("dur").alias("max_us"), F.count("*").alias("gaps"), S.round_half_up(F.sum("dur") / F.count("*")).alias("mean_us"))


_TOP = f"{_GAPS}, top AS (SELECT * FROM gap ORDER BY dur DESC, gap_start LIMIT 40)"


def _top_gaps(spark, d):
    ev, gaps = _gaps(spark, d)
    return ev, gaps.orderBy(F.desc("dur"), "gap_start").limit(40)


@query("gap_neighbours", f"""{_TOP}, pre AS (SELECT t.gap_start, max_by(idx, (ts, idx)) AS prev_idx FROM top t JOIN ev ON device = 'device' AND te <= t.gap_start + 1 GROUP BY t.gap_start),
nxt AS (SELECT t.gap_start, min_by(idx, (ts, idx)) AS next_idx FROM top t JOIN ev ON device = 'device' AND ts >= t.gap_end - 1 GROUP BY t.gap_start)
SELECT t.gap_start, t.gap_end, prev_idx, next_idx FROM top t LEFT JOIN pre USING (gap_start) LEFT JOIN nxt USING (gap_start)""")
def gap_neighbours(spark, d):
    """As-of neighbours of the 40 longest gaps: the latest start among those that ended, the earliest start after."""
    ev, top = _top_gaps(spark, d)
    dev = ev.where("device = 'device'").select("idx", "ts", "te")
    top = F.broadcast(top)  # 40 rows
    before = dev.join(top, F.expr("te <= gap_start + 1")).groupBy("gap_start", "gap_end").agg(F.max_by("idx", F.struct("ts", "idx")).alias("prev_idx"))
    after = dev.join(top, F.expr("ts >= gap_end - 1")).groupBy("gap_start").agg(F.min_by("idx", F.struct("ts", "idx")).alias("next_idx"))
    return top.join(before.select("gap_start", "prev_idx"), "gap_start", "left").join(after, "gap_start", "left").select("gap_start", "gap_end", "prev_idx", "next_idx")


@query("gap_host_top3", f"""{_TOP}, o AS (SELECT gap_start, name, CAST(sum(least(te, gap_end) - greatest(ts, gap_start)) AS BIGINT) AS total_us FROM top JOIN ev ON device = 'host' AND ts < gap_end AND te > gap_start GROUP BY gap_start, name),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY gap_start ORDER BY total_us DESC, name) AS INTEGER) AS place FROM o) SELECT * FROM r WHERE place <= 3""")
def gap_host_top3(spark, d):
    """The three host operators with most time inside each of the 40 longest gaps."""
    ev, top = _top_gaps(spark, d)
    over = ev.where("device = 'host'").select("name", "ts", "te").join(F.broadcast(top), F.expr("ts < gap_end and te > gap_start"))
    each = over.groupBy("gap_start", "name").agg(F.sum(F.expr("least(te, gap_end) - greatest(ts, gap_start)")).alias("total_us"))
    return each.selectExpr("*", "cast(row_number() over (partition by gap_start order by total_us desc, name) as int) as place").where("place <= 3")


@query("hit_test", f"{EV} SELECT stream, idx, ts, te FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY ts, idx) AS n FROM ev WHERE ts <= (SELECT min(ts) FROM ev) + {10 * DAY} AND te >= (SELECT min(ts) FROM ev) + {10 * DAY}) WHERE n = 1")
def hit_test(spark, d):
    """The operator under one moment in each lane."""
    ev = events(spark, d)
    at = ev.agg((F.min("ts") + 10 * DAY).alias("t"))
    hit = ev.join(F.broadcast(at)).where("ts <= t and te >= t")
    return hit.groupBy("stream").agg(F.min_by(F.struct("idx", "ts", "te"), F.struct("ts", "idx")).alias("b")).select("stream", "b.*")


# --- events -------------------------------------------------------------------------------------------------------------------


@query("rank_rebase", f"{EV} SELECT idx, rank, ts - min(ts) OVER (PARTITION BY rank) AS rel FROM ev")
def rank_rebase(spark, d):
    return D.rebased(events(spark, d)).select("idx", "rank", "rel")


@query("timeline_window", f"{EV} SELECT min(ts) AS ws, max(te) AS we, count(*) AS events, count(*) FILTER (WHERE device = 'host') AS host_events, count(*) FILTER (WHERE device = 'device') AS device_events, count(DISTINCT rank) AS ranks, (SELECT count(*) FROM (SELECT DISTINCT device, name FROM ev)) AS operators FROM ev")
def timeline_window(spark, d):
    ev = events(spark, d)
    return D.window_of(ev).join(F.broadcast(D.counts(ev)))


@query("normalize_names", f"{EV} SELECT raw_name, name, count(*) AS n FROM ev GROUP BY raw_name, name")
def normalize_names(spark, d):
    return events(spark, d).groupBy("raw_name", "name").agg(F.count("*").alias("n"))


_CLASS = """CASE WHEN raw_name LIKE 'hcom%' THEN 'comm' WHEN raw_name LIKE 'Memcpy%' THEN 'copy' WHEN device = 'device' THEN 'compute' ELSE 'schedule' END AS op_category,
CASE WHEN raw_name LIKE 'hcom%' THEN 'allreduce' WHEN raw_name LIKE 'Memcpy%' THEN 'd2h' WHEN device = 'device' THEN CASE WHEN raw_name LIKE 'Flash%' THEN 'attention' WHEN raw_name LIKE 'MatMul%' THEN 'matmul' ELSE 'other' END
  WHEN raw_name LIKE 'aten::%' THEN 'aten' ELSE 'host-other' END AS subtype,
CASE WHEN raw_name LIKE 'hcom%' THEN 'communication' WHEN raw_name LIKE 'Memcpy%' THEN 'transfer' WHEN device = 'device' THEN 'npu-kernel' ELSE 'framework' END AS role"""


@query("classify_ops", f"{EV} SELECT device, event_type, {_CLASS}, count(*) AS n FROM ev GROUP BY ALL")
def classify_ops(spark, d):
    ev = events(spark, d).withColumn("c", S.classify("raw_name", "device"))
    return ev.groupBy("device", "event_type", F.col("c.category").alias("op_category"), "c.subtype", "c.role").agg(F.count("*").alias("n"))


@query("lane_keys", f"{EV} SELECT concat(device, ':', stream) AS lane, count(*) AS n, CAST(sum(dur) AS BIGINT) AS total_us FROM ev GROUP BY 1")
def lane_keys(spark, d):
    return events(spark, d).groupBy(F.concat_ws(":", "device", F.col("stream").cast("string")).alias("lane")).agg(F.count("*").alias("n"), F.sum("dur").alias("total_us"))


_PH = "CASE k % 7 WHEN 0 THEN 'X' WHEN 1 THEN 'B' WHEN 2 THEN 'E' WHEN 3 THEN 'i' WHEN 4 THEN 'C' WHEN 5 THEN 's' ELSE 'M' END"


@query("ph_routing", f"{EV}, p AS (SELECT {_PH} AS ph FROM ev) SELECT ph, CASE WHEN ph IN ('X') THEN 'complete' WHEN ph IN ('B', 'E') THEN 'pair' WHEN ph = 'M' THEN 'metadata' WHEN ph = 'i' THEN 'instant' ELSE 'dropped' END AS route, count(*) AS n FROM p GROUP BY ALL")
def ph_routing(spark, d):
    route = F.expr("case when ph is null then 'other' when ph = 'X' then 'complete' when ph in ('B', 'E') then 'pair' when ph = 'M' then 'metadata' when ph = 'i' then 'instant' else 'dropped' end")
    return events(spark, d).select(F.expr(_PH).alias("ph")).groupBy("ph", route.alias("route")).agg(F.count("*").alias("n"))


@query("stride_sampling", f"""{EV}, s AS (SELECT *, row_number() OVER (ORDER BY idx) AS seen FROM ev)
SELECT idx, seen FROM s WHERE raw_name LIKE 'hcom%' OR raw_name LIKE 'Memcpy%' OR seen % CAST(ceil(seen / 4000.0) AS BIGINT) = 0 OR dur >= 4000000000""")
def stride_sampling(spark, d):
    return D.stride_sampled(events(spark, d), 4000, 4_000_000_000).select("idx", "seen")


@query("sampling_metadata", f"""{EV}, s AS (SELECT *, row_number() OVER (ORDER BY idx) AS seen FROM ev), k AS (SELECT count(*) AS kept FROM s WHERE raw_name LIKE 'hcom%' OR raw_name LIKE 'Memcpy%' OR seen % CAST(ceil(seen / 4000.0) AS BIGINT) = 0 OR dur >= 4000000000)
SELECT count(*) AS seen, max(kept) AS kept, count(*) - max(kept) AS dropped, CAST(ceil(count(*) / 4000.0) AS BIGINT) AS stride, max(te) - min(ts) AS raw_span FROM ev, k""")
def sampling_metadata(spark, d):
    ev = events(spark, d)
    kept = D.stride_sampled(ev, 4000, 4_000_000_000).agg(F.count("*").alias("kept"))
    return ev.agg(F.count("*").alias("seen"), (F.max("te") - F.min("ts")).alias("raw_span")).join(F.broadcast(kept)).selectExpr("seen", "kept", "seen - kept as dropped", "cast(ceil(seen / 4000) as bigint) as stride", "raw_span")


@query("begin_end_pairs", f"""{EV}, m AS (SELECT *, CASE WHEN idx % 3 = 1 THEN 'E' ELSE 'B' END AS ph FROM ev), p AS (SELECT rank, stream, event_type, ts, ph, lag(ph) OVER w AS pp, lag(ts) OVER w AS b FROM m WINDOW w AS (PARTITION BY rank, stream, event_type ORDER BY ts, idx))
SELECT rank, stream, event_type, b AS ts, ts - b AS dur FROM p WHERE ph = 'E' AND pp = 'B'""")
def begin_end_pairs(spark, d):
    marks = events(spark, d).withColumn("ph", F.expr("case when idx % 3 = 1 then 'E' else 'B' end"))
    return D.begin_end_pairs(marks, ["rank", "stream", "event_type"], "ts, idx", "ts", "ph")


@query("ph_statistics", f"""{EV}, m AS (SELECT *, CASE WHEN idx % 3 = 1 THEN 'E' ELSE 'B' END AS ph FROM ev), p AS (SELECT ph, lag(ph) OVER w AS pp, lead(ph) OVER w AS np FROM m WINDOW w AS (PARTITION BY rank, stream, event_type ORDER BY ts, idx))
SELECT count(*) FILTER (WHERE ph = 'B') AS begins, count(*) FILTER (WHERE ph = 'E') AS ends, count(*) FILTER (WHERE ph = 'E' AND (pp IS NULL OR pp <> 'B')) AS unmatched_ends, count(*) FILTER (WHERE ph = 'B' AND (np IS NULL OR np <> 'E')) AS unmatched_begins FROM p""")
def ph_statistics(spark, d):
    over = "over (partition by rank, stream, event_type order by ts, idx)"
    m = events(spark, d).withColumn("ph", F.expr("case when idx % 3 = 1 then 'E' else 'B' end")).selectExpr("ph", f"lag(ph) {over} as pp", f"lead(ph) {over} as np")
    return m.agg(*(F.count_if(F.expr(t)).alias(n) for n, t in (("begins", "ph = 'B'"), ("ends", "ph = 'E'"), ("unmatched_ends", "ph = 'E' and (pp is null or pp <> 'B')"), ("unmatched_begins", "ph = 'B' and (np is null or np <> 'E')"))))


@query("pid_label_join", f"""{EV}, l AS (SELECT n_nationkey AS pid, CASE WHEN n_nationkey % 3 = 0 THEN 'NPU ' || n_name WHEN n_nationkey % 3 = 1 THEN 'python ' || n_name ELSE n_name END AS label FROM nation)
SELECT label, CASE WHEN label LIKE 'NPU%' THEN 'device' WHEN label LIKE 'python%' THEN 'host' WHEN k IS NOT NULL AND k % 2 = 0 THEN 'device' ELSE 'host' END AS side, count(*) AS n FROM ev LEFT JOIN l ON user_id % 25 = pid GROUP BY ALL""")
def pid_label_join(spark, d):
    """Side of an event: its process label first, then what its arguments tell."""
    labels = table(spark, d, "nation").selectExpr("n_nationkey as pid", "case when n_nationkey % 3 = 0 then concat('NPU ', n_name) when n_nationkey % 3 = 1 then concat('python ', n_name) else n_name end as label")
    ev = events(spark, d).withColumn("__p", F.expr("user_id % 25"))
    side = F.coalesce(S.side_of_label("label"), F.expr("case when k is not null and k % 2 = 0 then 'device' else 'host' end"))
    return ev.join(labels, ev["__p"] == labels["pid"], "left").groupBy("label", side.alias("side")).agg(F.count("*").alias("n"))


@query("unit_inference", f"{EV}, u AS (SELECT count(*) FILTER (WHERE value > 0 AND value < 0.05) AS tiny, count(*) FILTER (WHERE value > 0) AS positive, max(te) - min(ts) AS span FROM ev) SELECT *, CASE WHEN tiny > 0.3 * positive OR span > 21600000000 THEN 'ms' ELSE 'us' END AS unit FROM u")
def unit_inference(spark, d):
    return D.time_unit(events(spark, d).withColumn("dur", F.col("value")))


@query("union_sources", f"{EV} SELECT source, count(*) AS n, CAST(sum(dur) AS BIGINT) AS total_us FROM (SELECT 'trace' AS source, dur FROM ev WHERE idx % 2 = 0 UNION ALL SELECT 'proto' AS source, dur FROM ev WHERE idx % 2 = 1) GROUP BY source")
def union_sources(spark, d):
    ev = events(spark, d)
    trace, proto = ev.where("idx % 2 = 0").select(F.lit("trace").alias("source"), "dur"), ev.where("idx % 2 = 1").select("dur", F.lit("proto").alias("source"))
    return trace.unionByName(proto, allowMissingColumns=True).groupBy("source").agg(F.count("*").alias("n"), F.sum("dur").alias("total_us"))


@query("dedup_ordered", f"{EV} SELECT name, min(idx) AS first_place, count(*) AS n FROM ev GROUP BY name")
def dedup_ordered(spark, d):
    return D.first_seen(events(spark, d), "name", "idx")


# --- scalars ------------------------------------------------------------------------------------------------------------------


@query("tolerant_numbers", """SELECT t AS text, TRY_CAST(nullif(regexp_replace(trim(t), '[,_ %]', '', 'g'), '') AS DOUBLE) AS number, n FROM (
SELECT CASE o_orderkey % 5 WHEN 0 THEN concat(CAST(o_custkey AS VARCHAR), ',', '000') WHEN 1 THEN concat(' ', CAST(o_custkey AS VARCHAR), '%') WHEN 2 THEN 'N/A' WHEN 3 THEN concat(CAST(o_custkey AS VARCHAR), '_1') ELSE 'x' || CAST(o_custkey AS VARCHAR) END AS t, count(*) AS n FROM orders GROUP BY 1)""")
def tolerant_numbers(spark, d):
    text = F.expr("case o_orderkey % 5 when 0 then concat(o_custkey, ',', '000') when 1 then concat(' ', o_custkey, '%') when 2 then 'N/A' when 3 then concat(o_custkey, '_1') else concat('x', o_custkey) end")
    return table(spark, d, "orders").groupBy(text.alias("text")).agg(F.count("*").alias("n")).select("text", S.number("text").alias("number"), "n")


@query("ratio_normalise", "SELECT l_quantity AS raw, CASE WHEN l_quantity > 1.5 THEN l_quantity / 100 ELSE l_quantity END AS share, count(*) AS n FROM lineitem GROUP BY 1")
def ratio_normalise(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_quantity").alias("raw")).agg(F.count("*").alias("n")).select("raw", S.ratio("raw").alias("share"), "n")


@query("header_units", """SELECT header, CASE WHEN header LIKE '%(ms)' THEN 'ms' WHEN header LIKE '%(ns)' THEN 'ns' WHEN header LIKE '%(s)' THEN 's' ELSE 'us' END AS unit, lower(regexp_replace(header, '[\\s_]+', '', 'g')) AS header_key,
CASE WHEN header LIKE '%(ms)' THEN 1500.0 WHEN header LIKE '%(ns)' THEN 0.0015 WHEN header LIKE '%(s)' THEN 1500000.0 ELSE 1.5 END AS us FROM (SELECT concat(r_name, ' Total_Time', CASE r_regionkey % 5 WHEN 0 THEN '(ms)' WHEN 1 THEN '(ns)' WHEN 2 THEN '(s)' WHEN 3 THEN '(us)' ELSE '' END) AS header FROM region)""")
def header_units(spark, d):
    h = table(spark, d, "region").selectExpr("concat(r_name, ' Total_Time', case r_regionkey % 5 when 0 then '(ms)' when 1 then '(ns)' when 2 then '(s)' when 3 then '(us)' else '' end) as header")
    return h.select("header", S.header_unit("header").alias("unit"), S.header_key("header").alias("header_key")).withColumn("us", S.to_us(F.lit(1.5), "unit"))


@query("rank_from_name", "SELECT name, nullif(regexp_extract(name, '(?:rank|device)_(\\d+)', 1), '') AS rank FROM (SELECT CASE s_suppkey % 3 WHEN 0 THEN 'rank_' || (s_suppkey % 16) || '/trace.json' WHEN 1 THEN 'device_' || (s_suppkey % 8) || '.csv' ELSE 'trace' || s_suppkey || '.json' END AS name FROM supplier)")
def rank_from_name(spark, d):
    n = table(spark, d, "supplier").selectExpr("case s_suppkey % 3 when 0 then concat('rank_', s_suppkey % 16, '/trace.json') when 1 then concat('device_', s_suppkey % 8, '.csv') else concat('trace', s_suppkey, '.json') end as name")
    return n.select("name", S.rank_from_name("name").alias("rank"))


@query("severity_grid", f"""SELECT v, {js('CASE WHEN v >= 25 THEN 0.5 + 0.5 * least(1, greatest(0, (v - 25) / 25.0)) ELSE 0 END', 4)} AS host_only, {js('CASE WHEN v <= 60 THEN 0.5 + 0.5 * least(1, greatest(0, (60 - v) / 30.0)) ELSE 0 END', 4)} AS latency, v < 12 AS exposed_low FROM (SELECT DISTINCT p_size * 2 AS v FROM part)""")
def severity_grid(spark, d):
    v = table(spark, d, "part").selectExpr("p_size * 2 as v").distinct()
    return v.select("v", S.round_half_up(S.severity("v", "hostOnlyGate"), 4).alias("host_only"), S.round_half_up(S.severity("v", "commLatencyBoundUs"), 4).alias("latency"), S.passes("v", "commExposedLow").alias("exposed_low"))


@query("stage_phases", "SELECT o_orderpriority AS stage, CASE WHEN o_orderpriority LIKE '1%' THEN 'prefill' WHEN o_orderpriority LIKE '2%' THEN 'decode' ELSE 'unknown' END AS phase, count(*) AS n FROM orders GROUP BY 1")
def stage_phases(spark, d):
    named = F.expr("case when o_orderpriority like '1%' then 'Prefill stage' when o_orderpriority like '2%' then 'decode' else o_orderpriority end")
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("stage"), S.stage_phase(named).alias("phase")).agg(F.count("*").alias("n"))


# --- tables -------------------------------------------------------------------------------------------------------------------


@query("utilisation_unpivot", f"{INST} SELECT name, metric, count(*) AS n, {js('avg(v)', 4)} AS mean FROM (SELECT name, 'mac' AS metric, mac50 / 50.0 AS v FROM inst UNION ALL SELECT name, 'mte2', mte2_100 / 10.0 FROM inst) GROUP BY name, metric")
def utilisation_unpivot(spark, d):
    """Metric columns as a map, then as rows."""
    m = instances(spark, d).select("name", F.expr("map_filter(map('mac', mac50 / 50.0D, 'mte2', mte2_100 / 10.0D), (k, v) -> v is not null)").alias("m")).select("name", F.explode("m").alias("metric", "v"))
    return m.groupBy("name", "metric").agg(F.count("*").alias("n"), S.round_half_up(F.avg("v"), 4).alias("mean"))


@query("extra_map", "SELECT s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN s_name END AS col0, CAST(s_nationkey AS VARCHAR) AS col1, CASE WHEN s_nationkey % 2 = 0 THEN 2 ELSE 1 END AS extras FROM supplier")
def extra_map(spark, d):
    """Columns without a canonical name, as a map of those that have a value."""
    x = table(spark, d, "supplier").selectExpr("s_suppkey", "map_filter(map('col0', if(s_nationkey % 2 = 0, s_name, null), 'col1', cast(s_nationkey as string)), (k, v) -> v is not null) as extra")
    return x.selectExpr("s_suppkey", "extra['col0'] as col0", "extra['col1'] as col1", "size(extra) as extras")


@query("step_unit_rescale", f"{STEPS} SELECT step, computing + comm + free AS total, CASE WHEN (SELECT max((computing + comm + free) / 1e9) FROM st) < 2000 THEN 1000 ELSE 1 END AS scale FROM st")
def step_unit_rescale(spark, d):
    return P.rescaled(steps(spark, d).selectExpr("step", "computing + comm + free as total", "(computing + comm + free) / 1e9D as ms"), "ms").select("step", "total", "scale")


_KINDS = f"""{INST}, t AS (SELECT 'kernel_details' AS kind, name, dur_us, wait_us, device_id FROM inst UNION ALL SELECT 'op_summary', name, dur_us, wait_us, device_id FROM inst WHERE device_id < 4 UNION ALL SELECT 'api_statistic', name, dur_us * 3, wait_us, device_id FROM inst WHERE device_id = 0),
ts AS (SELECT kind, name, count(*) AS count, CAST(sum(dur_us) AS BIGINT) AS total_us FROM t GROUP BY kind, name)"""


def _kinds(spark, d):
    inst = instances(spark, d)
    part = lambda kind, rows: rows.withColumn("kind", F.lit(kind))
    rows = part("kernel_details", inst).unionByName(part("op_summary", inst.where("device_id < 4"))).unionByName(part("api_statistic", inst.where("device_id = 0").withColumn("dur_us", F.col("dur_us") * 3)))
    return D.table_stats(rows, ["kind", "name"])


@query("table_stats", f"{INST} SELECT name, count(*) AS count, CAST(sum(dur_us) AS BIGINT) AS total_us, CAST(sum(wait_us) AS BIGINT) AS wait_us, count(DISTINCT device_id) AS devices, {js('CAST(sum(mac50 * dur_us) AS DOUBLE) / sum(dur_us) / 50', 4)} AS mac, {js('CAST(sum(mte2_100 * dur_us) AS DOUBLE) / sum(dur_us) / 10', 4)} AS mte2 FROM inst GROUP BY name")
def table_stats(spark, d):
    return D.table_stats(instances(spark, d), ["name"])


@query("table_priority", f"""{_KINDS}, o AS (SELECT *, CASE kind WHEN 'op_summary' THEN 1 WHEN 'kernel_details' THEN 2 ELSE 7 END AS p FROM ts)
SELECT name, min_by(kind, p) AS kind, min_by(count, p) AS count, min_by(total_us, p) AS total_us, string_agg(kind, ',' ORDER BY kind) AS kinds FROM o GROUP BY name""")
def table_priority(spark, d):
    return D.believed(_kinds(spark, d))


@query("table_disagreement", f"{_KINDS}, o AS (SELECT name, max(total_us) AS high, min(total_us) AS low, count(*) AS tables FROM ts WHERE kind <> 'api_statistic' AND total_us > 0 GROUP BY name) SELECT *, {js('(high - low) / CAST(high AS DOUBLE)', 4)} AS spread FROM o WHERE tables >= 2 AND (high - low) / CAST(high AS DOUBLE) > 0.2")
def table_disagreement(spark, d):
    return D.disagreeing(_kinds(spark, d))


@query("table_totals", f"{_KINDS} SELECT kind, count(*) AS row_count, CAST(sum(dur_us) AS BIGINT) AS total_us FROM t GROUP BY kind")
def table_totals(spark, d):
    return _kinds(spark, d).groupBy("kind").agg(F.sum("count").alias("row_count"), F.sum("total_us").alias("total_us"))


@query("table_summaries", "SELECT s_nationkey % 4 AS table_id, count(*) AS row_count, count(DISTINCT s_nationkey) AS columns_seen, array_to_string(list_slice(list_sort(list(DISTINCT s_nationkey)), 1, 3), ',') AS first_columns FROM supplier GROUP BY 1")
def table_summaries(spark, d):
    s = table(spark, d, "supplier").groupBy(F.expr("s_nationkey % 4").alias("table_id"))
    return s.agg(F.count("*").alias("row_count"), F.countDistinct("s_nationkey").alias("columns_seen"), F.array_join(F.slice(F.array_sort(F.collect_set("s_nationkey")), 1, 3).cast("array<string>"), ",").alias("first_columns"))


_SPLIT = f"""{EV}, tr AS (SELECT device, name, count(*) AS c, CAST(sum(dur) AS BIGINT) AS u FROM ev WHERE rank < 3 GROUP BY ALL), tb AS (SELECT name, count(*) AS c, CAST(sum(dur) AS BIGINT) AS u FROM ev WHERE device = 'device' GROUP BY name)"""


def _merge(spark, d, sampled):
    """Traces of three ranks beside a table of all four."""
    ev = events(spark, d)
    stats = lambda x, *k: x.groupBy(*k).agg(F.count("*").alias("count"), F.sum("dur").alias("total_us"))
    return D.merged(stats(ev.where("rank < 3"), "device", "name"), stats(ev.where("device = 'device'"), "name"), sampled)


@query("trace_table_merge", f"""{_SPLIT} SELECT coalesce(tr.name, tb.name) AS name, coalesce(tr.device, 'device') AS device, CASE WHEN tr.u IS NULL THEN tb.c ELSE tr.c END AS count, coalesce(tr.u, tb.u) AS total_us, tr.u AS trace_us, tb.u AS table_us, CASE WHEN tr.u IS NULL THEN 'table' ELSE 'trace' END AS source,
CASE WHEN tr.u IS NOT NULL AND tb.u IS NOT NULL AND tr.u <> 0 THEN {js('(tb.u - tr.u) / CAST(greatest(1, tr.u) AS DOUBLE) * 100', 1)} END AS cross_check_pct FROM tr FULL JOIN tb ON tr.name = tb.name""")
def trace_table_merge(spark, d):
    return _merge(spark, d, False)


@query("cross_check", f"""{_SPLIT} SELECT coalesce(tr.name, tb.name) AS name, coalesce(tr.device, 'device') AS device, CASE WHEN tb.u IS NOT NULL THEN 'table' ELSE 'trace' END AS source,
CASE WHEN tr.u IS NOT NULL AND tb.u IS NOT NULL AND tr.u <> 0 THEN {js('(tr.u - tb.u) / CAST(greatest(1, tb.u) AS DOUBLE) * 100', 1)} END AS cross_check_pct FROM tr FULL JOIN tb ON tr.name = tb.name""")
def cross_check(spark, d):
    return _merge(spark, d, True).select("name", "device", "source", "cross_check_pct")


@query("weighted_utilisation", f"{INST} SELECT 'mac' AS metric, {js('CAST(sum(mac50 * dur_us) AS DOUBLE) / sum(dur_us) / 50', 4)} AS value, CAST(sum(dur_us) AS BIGINT) AS weight FROM inst UNION ALL SELECT 'mte2', {js('CAST(sum(mte2_100 * dur_us) AS DOUBLE) / sum(dur_us) / 10', 4)}, CAST(sum(dur_us) AS BIGINT) FROM inst")
def weighted_utilisation(spark, d):
    return D.weighted_metrics(instances(spark, d))


@query("utilisation_in_window", f"{INST} SELECT name, {js('CAST(sum(mac50 * dur_us) AS DOUBLE) / sum(dur_us) / 50', 4)} AS mac FROM inst WHERE name IN (SELECT p_type FROM part WHERE p_size <= 2) GROUP BY name")
def utilisation_in_window(spark, d):
    inst, names = instances(spark, d), table(spark, d, "part").where("p_size <= 2").select(F.col("p_type").alias("__n"))
    return D.table_stats(inst.join(names, inst["name"] == names["__n"], "left_semi"), ["name"]).select("name", "mac")


@query("throughput", f"{INST}, t AS (SELECT sum(CAST(mac50 AS BIGINT) * 1000000) AS f, sum(dur_us) AS d FROM inst), r AS (SELECT CAST(f AS DOUBLE) / (CAST(d AS DOUBLE) / 1e6) / 1e12 AS x FROM t) SELECT {js('x', 6)} AS tflops, {js('x / 320 * 100', 4)} AS of_peak_pct FROM r")
def throughput(spark, d):
    return D.throughput(instances(spark, d).withColumn("flops", F.expr("mac50 * 1000000")), "flops", "dur_us", 320.0)


# --- operators ----------------------------------------------------------------------------------------------------------------

_STAT = f"""{EV}, stat AS (SELECT device, name, count(*) AS count, CAST(sum(dur) AS BIGINT) AS total_us, max(dur) AS max_us, quantile_disc(dur, 0.5) AS p50_us, quantile_disc(dur, 0.95) AS p95_us, array_to_string(list_slice(list_sort(list(DISTINCT stream)), 1, 16), ',') AS streams,
count(DISTINCT rank) AS ranks, count(DISTINCT category) > 1 AS ambiguous, {js('CAST(sum(dur) AS DOUBLE) / count(*)')} AS avg_us FROM ev GROUP BY device, name)"""


@query("operator_stats", f"{_STAT} SELECT * FROM stat")
def operator_stats(spark, d):
    return D.operator_stats(events(spark, d)).withColumn("streams", F.array_join(F.col("streams").cast("array<string>"), ","))


@query("dominant_category", f"{EV}, c AS (SELECT device, name, category, CAST(sum(dur) AS BIGINT) AS total_us, min(idx) AS f FROM ev GROUP BY device, name, category) SELECT device, name, category, total_us FROM (SELECT *, row_number() OVER (PARTITION BY device, name ORDER BY total_us DESC, f) AS n FROM c) WHERE n = 1")
def dominant_category(spark, d):
    return D.dominant_category(events(spark, d))


@query("longest_sample", f"{EV} SELECT device, name, idx, dur, ts FROM (SELECT *, row_number() OVER (PARTITION BY device, name ORDER BY dur DESC, idx) AS n FROM ev) WHERE n = 1")
def longest_sample(spark, d):
    return D.longest_sample(events(spark, d))


_CAT = f"""{EV}, c AS (SELECT unnest(['compute', 'comm', 'copy', 'schedule', 'other']) AS category), t AS (SELECT category, coalesce(sum(dur), 0) AS total_us, coalesce(sum(dur) FILTER (WHERE device = 'host'), 0) AS host_us, coalesce(sum(dur) FILTER (WHERE device = 'device'), 0) AS device_us, count(dur) AS count FROM c LEFT JOIN ev USING (category) GROUP BY category)
SELECT category, CAST(total_us AS BIGINT) AS total_us, CAST(host_us AS BIGINT) AS host_us, CAST(device_us AS BIGINT) AS device_us, count, {js(pct('total_us', '(SELECT sum(total_us) FROM t)'))} AS share_pct FROM t"""


@query("category_totals", _CAT)
def category_totals(spark, d):
    return D.category_totals(events(spark, d))


@query("category_scopes", f"{EV}, s AS (SELECT 'all' AS scope, category, dur FROM ev UNION ALL SELECT device, category, dur FROM ev) SELECT scope, category, CAST(sum(dur) AS BIGINT) AS total_us, {js(pct('sum(dur)', '(sum(sum(dur)) OVER (PARTITION BY scope))'))} AS share_pct FROM s GROUP BY scope, category")
def category_scopes(spark, d):
    """Composition of all, host and device time: grouping sets in one pass."""
    both = events(spark, d).groupingSets([["category"], ["device", "category"]], "device", "category").agg(F.sum("dur").alias("total_us"), F.grouping("device").alias("g"))
    out = both.selectExpr("if(g = 1, 'all', device) as scope", "category", "total_us", "sum(total_us) over (partition by if(g = 1, 'all', device)) as whole")
    return out.select("scope", "category", "total_us", S.round_half_up(S.percent_of("total_us", "whole")).alias("share_pct"))


@query("rank_total", f"{_STAT} SELECT CAST(row_number() OVER (ORDER BY total_us DESC, device, name) AS INTEGER) AS rank, device, name, count, total_us, {js(pct('total_us', '(SELECT sum(total_us) FROM stat)'))} AS share_pct FROM stat ORDER BY total_us DESC, device, name LIMIT 20")
def rank_total(spark, d):
    return D.ranked(D.operator_stats(events(spark, d)), "total_us").select("rank", "device", "name", "count", "total_us", "share_pct")


@query("rank_average", f"{_STAT} SELECT CAST(row_number() OVER (ORDER BY avg_us DESC, device, name) AS INTEGER) AS rank, device, name, avg_us FROM stat ORDER BY avg_us DESC, device, name LIMIT 20")
def rank_average(spark, d):
    return D.ranked(D.operator_stats(events(spark, d)), "avg_us").select("rank", "device", "name", "avg_us")


@query("ranking_scoped", f"{_STAT}, f AS (SELECT * FROM stat WHERE device = 'device') SELECT name, count, {js(pct('count', '(SELECT sum(count) FROM f)'))} AS share_pct FROM f ORDER BY count DESC, name LIMIT 10")
def ranking_scoped(spark, d):
    """Ranking by count within one side, with shares of that side."""
    f = D.operator_stats(events(spark, d)).where("device = 'device'")
    return f.orderBy(F.desc("count"), "name").limit(10).join(F.broadcast(f.agg(F.sum("count").alias("w")))).select("name", "count", S.round_half_up(S.percent_of("count", "w")).alias("share_pct"))


@query("lane_sort_modes", f"{_STAT}, u AS (SELECT 'total' AS mode, name, row_number() OVER (ORDER BY total_us DESC, name) AS place FROM stat WHERE device = 'host' UNION ALL SELECT 'count', name, row_number() OVER (ORDER BY count DESC, name) FROM stat WHERE device = 'host' UNION ALL SELECT 'name', name, row_number() OVER (ORDER BY name) FROM stat WHERE device = 'host' UNION ALL SELECT 'max', name, row_number() OVER (ORDER BY max_us DESC, name) FROM stat WHERE device = 'host') SELECT mode, name, CAST(place AS INTEGER) AS place FROM u WHERE place <= 5")
def lane_sort_modes(spark, d):
    host = D.operator_stats(events(spark, d)).where("device = 'host'")
    modes = [("total", "total_us desc, name"), ("count", "count desc, name"), ("name", "name"), ("max", "max_us desc, name")]
    parts = [host.selectExpr(f"'{m}' as mode", "name", f"cast(row_number() over (partition by device order by {o}) as int) as place").where("place <= 5") for m, o in modes]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("lane_overflow", f"""{_STAT}, p AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY total_us DESC, name) AS place FROM stat)
SELECT device, name, count, total_us, avg_us, max_us, p50_us, p95_us, CAST(0 AS BIGINT) AS folded FROM p WHERE place <= 10 UNION ALL
SELECT device, '(other)', CAST(sum(count) AS BIGINT), CAST(sum(total_us) AS BIGINT), {js('avg(avg_us)')}, max(max_us), quantile_disc(p50_us, 0.5), quantile_disc(p95_us, 0.95), count(*) FROM p WHERE place > 10 GROUP BY device""")
def lane_overflow(spark, d):
    return D.with_overflow(D.operator_stats(events(spark, d)), 10)


@query("compute_subtypes", f"{EV}, c AS (SELECT *, {_CLASS} FROM ev) SELECT subtype, CAST(sum(dur) AS BIGINT) AS total_us, count(*) AS count FROM c WHERE op_category = 'compute' GROUP BY subtype ORDER BY total_us DESC LIMIT 5")
def compute_subtypes(spark, d):
    c = events(spark, d).withColumn("c", S.classify("raw_name", "device")).where("c.category = 'compute'")
    return c.groupBy("c.subtype").agg(F.sum("dur").alias("total_us"), F.count("*").alias("count")).orderBy(F.desc("total_us"), "subtype").limit(5)


@query("target_operators", f"{_STAT} SELECT name, total_us FROM stat WHERE device = 'device' AND name LIKE 'MatMul%' ORDER BY total_us DESC, name LIMIT 3")
def target_operators(spark, d):
    """Operators that an advice is about."""
    return D.operator_stats(events(spark, d)).where("device = 'device' and name like 'MatMul%'").orderBy(F.desc("total_us"), "name").limit(3).select("name", "total_us")


# --- steps and phases ---------------------------------------------------------------------------------------------------------


def _days(spark, d, ev=None):
    ev = events(spark, d) if ev is None else ev
    return ev, ev.select(F.expr(f"ts div {DAY}").alias("__d")).distinct().selectExpr("cast(__d as bigint) as step", f"__d * {DAY} as ws", f"__d * {DAY} + {DAY // 2} as we")


_DAYS = f"{EV}, st AS (SELECT DISTINCT ts // {DAY} AS step, (ts // {DAY}) * {DAY} AS ws, (ts // {DAY}) * {DAY} + {DAY // 2} AS we FROM ev), ins AS (SELECT ev.*, step FROM ev JOIN st ON ts >= ws AND ts < we)"


@query("step_containment", f"{_DAYS} SELECT step, count(*) AS events, CAST(sum(dur) AS BIGINT) AS total_us, min(idx) AS first_idx FROM ins GROUP BY step")
def step_containment(spark, d):
    ev, days = _days(spark, d)
    return I.contained(ev, days, "ts").groupBy("step").agg(F.count("*").alias("events"), F.sum("dur").alias("total_us"), F.min("idx").alias("first_idx"))


@query("phase_membership", f"{_DAYS} SELECT device, count(*) AS events FROM ev WHERE EXISTS (SELECT 1 FROM st WHERE step % 2 = 0 AND ev.ts >= ws AND ev.ts < we) GROUP BY device")
def phase_membership(spark, d):
    """Events inside any step of a phase."""
    ev, days = _days(spark, d)
    return I.contained(ev, days.where("step % 2 = 0"), "ts").groupBy("device").agg(F.count("*").alias("events"))


@query("step_window_overlap", f"{_DAYS}, w AS (SELECT min(ts) + {5 * DAY} AS a, min(ts) + {9 * DAY} AS b FROM ev) SELECT count(*) AS steps FROM st, w WHERE ws < b AND we > a")
def step_window_overlap(spark, d):
    ev, days = _days(spark, d)
    w = ev.agg((F.min("ts") + 5 * DAY).alias("a"), (F.min("ts") + 9 * DAY).alias("b"))
    return days.join(F.broadcast(w)).where("ws < b and we > a").agg(F.count("*").alias("steps"))


@query("step_tokens", f"{_DAYS} SELECT step, min_by(k, (ts, idx)) AS tokens, min(ts) AS ts FROM ins WHERE k IS NOT NULL GROUP BY step")
def step_tokens(spark, d):
    """Token count of a step: that of its first event with one."""
    ev, days = _days(spark, d)
    return I.contained(ev.where("k is not null"), days, "ts").groupBy("step").agg(F.min_by("k", F.struct("ts", "idx")).alias("tokens"), F.min("ts").alias("ts"))


@query("mean_tokens", f"{_DAYS}, t AS (SELECT step, min_by(k, (ts, idx)) AS tokens FROM ins WHERE k IS NOT NULL GROUP BY step) SELECT {js('avg(tokens)')} AS mean_tokens FROM t")
def mean_tokens(spark, d):
    return step_tokens(spark, d).agg(S.round_half_up(F.avg("tokens")).alias("mean_tokens"))


_SM = f"""{_DAYS}, {swp('ins', 'device', 'device', 'host', 'step', 'bz')}, dv AS (SELECT * FROM ins WHERE device = 'device'), {swp('dv', 'category', 'comm', 'compute', 'step', 'cm')},
sm AS (SELECT st.step, we - ws AS wall_us, (SELECT count(*) FROM ins i WHERE i.step = st.step) AS events, coalesce(bz.left_us, 0) AS device_busy_us, coalesce(bz.right_us, 0) AS host_busy_us, greatest(0, we - ws - coalesce(bz.left_us, 0)) AS idle_us,
CAST(coalesce((SELECT sum(dur) FROM dv WHERE dv.step = st.step AND category = 'compute'), 0) AS BIGINT) AS compute_us, CAST(coalesce((SELECT sum(dur) FROM dv WHERE dv.step = st.step AND category = 'copy'), 0) AS BIGINT) AS copy_us,
coalesce(cm.left_us, 0) AS comm_us, coalesce(cm.both_us, 0) AS comm_overlap_us, coalesce(cm.left_only_us, 0) AS comm_exposed_us FROM st LEFT JOIN bz USING (step) LEFT JOIN cm USING (step) WHERE EXISTS (SELECT 1 FROM ins i WHERE i.step = st.step))"""


@query("step_metrics", f"{_SM} SELECT * FROM sm")
def step_metrics(spark, d):
    ev, days = _days(spark, d)
    return P.step_metrics(ev, days)


@query("phase_summary", f"{_SM}, p AS (SELECT *, CASE WHEN step % 3 = 0 THEN 'prefill' ELSE 'decode' END AS phase FROM sm) SELECT phase, count(*) AS steps, CAST(sum(wall_us) AS BIGINT) AS wall_us, min(wall_us) AS min_step_us, max(wall_us) AS max_step_us, CAST(sum(device_busy_us) AS BIGINT) AS device_busy_us, CAST(sum(comm_us) AS BIGINT) AS comm_us, CAST(sum(compute_us) AS BIGINT) AS compute_us, {js('CAST(sum(wall_us) AS DOUBLE) / count(*)')} AS avg_step_us, {js(pct('sum(device_busy_us)', 'sum(wall_us)'))} AS busy_pct, {js(pct('sum(comm_us)', 'sum(wall_us)'))} AS comm_pct FROM p GROUP BY phase")
def phase_summary(spark, d):
    return P.phase_summary(step_metrics(spark, d).withColumn("phase", F.expr("if(step % 3 = 0, 'prefill', 'decode')")))


@query("phase_mix", f"{_SM}, p AS (SELECT CASE WHEN step % 3 = 0 THEN 'prefill' ELSE 'decode' END AS phase, wall_us FROM sm) SELECT phase, {js(pct('sum(wall_us)', '(SELECT max(te) - min(ts) FROM ev)'))} AS share_pct FROM p GROUP BY phase")
def phase_mix(spark, d):
    whole = events(spark, d).agg((F.max("te") - F.min("ts")).alias("w"))
    return phase_summary(spark, d).join(F.broadcast(whole)).select("phase", S.round_half_up(S.percent_of("wall_us", "w")).alias("share_pct"))


@query("marker_steps", f"{EV}, m AS (SELECT idx, ts, te, lead(ts) OVER (ORDER BY ts, idx) AS nx, CASE WHEN k % 2 = 0 THEN 'prefill' ELSE 'decode' END AS declared FROM ev WHERE idx % 100 = 0), n AS (SELECT *, coalesce(nx, te) AS we FROM m) SELECT CAST(row_number() OVER (ORDER BY ts, idx) - 1 AS INTEGER) AS step, ts AS ws, we, declared FROM n WHERE we > ts")
def marker_steps(spark, d):
    return P.marker_steps(events(spark, d), F.expr("idx % 100 = 0"), F.expr("if(k % 2 = 0, 'prefill', 'decode')"))


@query("marker_assignment", f"{_DAYS}, m AS (SELECT idx, ts FROM ev WHERE idx % 50 = 0) SELECT step, min_by(m.idx, (m.ts, m.idx)) AS marker FROM st JOIN m ON m.ts >= ws AND m.ts < we GROUP BY step")
def marker_assignment(spark, d):
    """The first marker inside each step."""
    ev, days = _days(spark, d)
    return I.contained(ev.where("idx % 50 = 0"), days, "ts").groupBy("step").agg(F.min_by("idx", F.struct("ts", "idx")).alias("marker"))


@query("engine_steps", f"{EV}, h AS (SELECT * FROM ev WHERE device = 'host' AND name LIKE 'MatMul%'), b AS (SELECT name FROM h GROUP BY name HAVING count(*) >= 3 ORDER BY count(*) DESC, sum(dur) DESC, name LIMIT 1), o AS (SELECT h.*, max(te) OVER (ORDER BY ts, te DESC, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM h JOIN b USING (name)) SELECT name, ts AS ws, te AS we FROM o WHERE m IS NULL OR ts >= m")
def engine_steps(spark, d):
    return P.engine_steps(events(spark, d), "^MatMul")


@query("gap_segments", f"""{EV}, {isl('ev')}, g AS (SELECT s, e, s - lag(e) OVER (ORDER BY s) AS gap FROM isl), m AS (SELECT greatest(200, 4 * list_sort(list(gap))[count(*) // 2 + 1]) AS lim FROM g WHERE gap > 0),
c AS (SELECT g.*, sum(CASE WHEN gap > lim THEN 1 ELSE 0 END) OVER (ORDER BY s ROWS UNBOUNDED PRECEDING) AS segment FROM g, m) SELECT CAST(segment AS INTEGER) AS segment, min(s) AS ws, max(e) AS we FROM c GROUP BY segment""")
def gap_segments(spark, d):
    return P.gap_segments(events(spark, d))


@query("step_cumulative", f"{STEPS} SELECT step, CAST(coalesce(sum(computing + comm + free) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ws, CAST(sum(computing + comm + free) OVER (ORDER BY step) AS BIGINT) AS we FROM st")
def step_cumulative(spark, d):
    return P.cumulative_steps(steps(spark, d).withColumn("total_us", F.expr("computing + comm + free")))


_TWO = """h AS (SELECT CAST(floor(log10(CAST(v AS DOUBLE)) * 10000 + 0.5) AS BIGINT) AS x, count(*) AS c FROM vals WHERE v > 0 GROUP BY 1),
k AS (SELECT 0 AS i, CAST(min(x) AS DOUBLE) AS lo, CAST(max(x) AS DOUBLE) AS hi FROM h UNION ALL
  SELECT i + 1, coalesce((SELECT CAST(sum(x * c) AS DOUBLE) / sum(c) FROM h WHERE abs(x - lo) <= abs(x - hi)), lo), coalesce((SELECT CAST(sum(x * c) AS DOUBLE) / sum(c) FROM h WHERE abs(x - lo) > abs(x - hi)), hi) FROM k WHERE i < 64),
z AS (SELECT * FROM k WHERE i = 64), two AS (SELECT CAST((SELECT sum(c) FROM h) AS BIGINT) AS n, lo, hi, (SELECT sum(c) FROM h) >= 4 AND ((SELECT max(x) - min(x) FROM h) / 10000.0) >= 0.35 AND (hi - lo) / 10000 >= 0.35 AS split FROM z)"""


@query("two_means", f"WITH RECURSIVE vals AS (SELECT l_extendedprice AS v FROM lineitem), {_TWO} SELECT n, {js('lo / 10000', 4)} AS low, {js('hi / 10000', 4)} AS high, split, {js('pow(10, (lo + hi) / 20000)')} AS limit_us FROM two")
def two_means(spark, d):
    return P.two_means(table(spark, d, "lineitem"), "l_extendedprice").drop("cut")


@query("phase_labels", f"""WITH RECURSIVE {STEPS[5:]}, vals AS (SELECT computing + comm + free AS v FROM st), {_TWO}, u AS (SELECT count(*) >= 8 AND stddev_pop(v) / avg(v) < 0.25 AS uniform FROM vals WHERE v > 0),
l AS (SELECT step, computing + comm + free AS total_us, split, uniform, CASE WHEN split THEN CASE WHEN computing + comm + free >= pow(10, (lo + hi) / 20000) THEN 'prefill' ELSE 'decode' END WHEN uniform THEN 'decode' ELSE 'unknown' END AS phase FROM st, two, u)
SELECT step, total_us, phase, CASE WHEN split THEN 'duration-bimodal' WHEN uniform THEN 'uniform-decode' ELSE 'undetermined' END AS method,
CASE WHEN split AND (SELECT count(DISTINCT phase) FROM l) = 2 THEN 'medium' ELSE 'low' END AS confidence FROM l""")
def phase_labels(spark, d):
    return P.labelled(steps(spark, d).selectExpr("step", "computing + comm + free as total_us"), "total_us")


@query("phase_labels_declared", f"{STEPS} SELECT step, CASE WHEN month % 3 = 0 THEN 'Prefill' WHEN month % 3 = 1 THEN 'token_phase' END AS stage, computing AS total_us, CASE WHEN month % 3 = 0 THEN 'prefill' WHEN month % 3 = 1 THEN 'decode' ELSE 'unknown' END AS phase, 'step-table-stage' AS method, 'high' AS confidence FROM st")
def phase_labels_declared(spark, d):
    """A stage column decides, whatever the durations."""
    return P.labelled(steps(spark, d).selectExpr("step", "case when month % 3 = 0 then 'Prefill' when month % 3 = 1 then 'token_phase' end as stage", "computing as total_us"), "total_us")


@query("phase_labels_marked", f"""{_DAYS}, m AS (SELECT idx, ts, CASE WHEN k % 2 = 0 THEN 'prefill' ELSE 'decode' END AS ph FROM ev WHERE idx % 7 = 0), f AS (SELECT step, min_by(ph, (ts, idx)) AS ph FROM st JOIN m ON ts >= ws AND ts < we GROUP BY step)
SELECT st.step, ws, we, coalesce(ph, 'unknown') AS phase FROM st LEFT JOIN f ON st.step = f.step""")
def phase_labels_marked(spark, d):
    """The first marker inside a step names it."""
    ev, days = _days(spark, d)
    markers = ev.where("idx % 7 = 0").selectExpr("ts", "te", "idx", "if(k % 2 = 0, 'prefill', 'decode') as phase")
    return P.labelled(days.withColumn("wall_us", F.expr("we - ws")), "wall_us", markers).select("step", "ws", "we", "phase")


@query("step_sources", f"{STEPS} SELECT count(*) AS steps, 'table' AS source FROM st")
def step_sources(spark, d):
    """The first source of steps that has any: a table, markers, engine runs, pauses, the whole window."""
    ev = events(spark, d)
    table_steps = P.cumulative_steps(steps(spark, d).withColumn("total_us", F.expr("computing + comm + free")))
    sources = [("table", table_steps), ("markers", P.marker_steps(ev, F.expr("name = 'prefill'"))), ("engine", P.engine_steps(ev).selectExpr("0 as step", "ws", "we")), ("gaps", P.gap_segments(ev)), ("window", P.whole_window(ev))]
    name, found = P.choose_steps(sources)
    return found.agg(F.count("*").alias("steps")).withColumn("source", F.lit(name))


# --- rules --------------------------------------------------------------------------------------------------------------------


def _blocks(spark, d):
    """Indicator rows of three scopes: the first quarter as prefill, the second half as decode, and overall, judged as the longer of both."""
    ev = events(spark, d)
    c = S.classify("raw_name", "device")
    ev = ev.withColumn("c", c).selectExpr("idx", "device", "category", "c.subtype as subtype", "c.role as role", "name", "ts", "te", "dur")
    ev = kept(ev.drop("idx"), "block-events")
    w = ev.agg(F.min("ts").alias("a"), F.max("te").alias("b")).first()
    a, b = (w["a"], w["b"]) if w["a"] is not None else (0, 0)
    parts = [("prefill", "prefill", a, a + (b - a) // 4, 8), ("decode", "decode", a + (b - a) // 2, b, 15)]
    longest = max(parts, key=lambda x: x[3] - x[2])[1]
    scopes = spark.createDataFrame([("overall", longest, a, b, 30), *parts], "scope string, phase string, ws long, we long, steps int")
    context = "cast(null as double) as mac", "cast(null as double) as mte2", "true as phaseMix", "'low' as phaseConfidence", "false as missingTables"
    return A.settled(A.indicators(ev, scopes).selectExpr("*", *context))


_SC = f"""{EV}, cl AS (SELECT *, {_CLASS} FROM ev), w AS (SELECT min(ts) AS a, max(te) AS b FROM ev), sp AS (SELECT 'prefill' AS scope, a AS ws, a + (b - a) // 4 AS we, 8 AS steps FROM w UNION ALL SELECT 'decode', a + (b - a) // 2, b, 15 FROM w),
sc AS (SELECT 'overall' AS scope, (SELECT max_by(scope, we - ws) FROM sp) AS phase, a AS ws, b AS we, 30 AS steps FROM w UNION ALL SELECT scope, scope, ws, we, steps FROM sp),
es AS (SELECT cl.*, scope FROM cl JOIN sc ON ts >= ws AND ts < we), {swp('es', 'device', 'device', 'host', 'scope', 'bz')}, dv AS (SELECT * FROM es WHERE device = 'device'), {swp('dv', 'category', 'comm', 'compute', 'scope', 'cm')}, {isl('dv', 'scope')},
pts AS (SELECT scope, s, e FROM isl UNION ALL SELECT scope, ws, ws FROM sc UNION ALL SELECT scope, we, we FROM sc), gp AS (SELECT scope, g1 - g0 AS g FROM (SELECT scope, e AS g0, lead(s) OVER (PARTITION BY scope ORDER BY s, e) AS g1 FROM pts) WHERE g1 - g0 > 50),
gs AS (SELECT scope, sum(g) AS idle, max(g) AS gmax, count(*) AS gn FROM gp GROUP BY scope),
sm AS (SELECT scope, count(*) AS n, count(*) FILTER (WHERE device = 'device') AS dn, count(*) FILTER (WHERE device = 'host') AS hn, coalesce(sum(dur) FILTER (WHERE device = 'device' AND category = 'compute'), 0) AS ku, coalesce(sum(dur) FILTER (WHERE device = 'device' AND category = 'copy'), 0) AS yu,
  coalesce(sum(dur) FILTER (WHERE device = 'host'), 0) AS hs, count(*) FILTER (WHERE device = 'device' AND category = 'comm') AS cn, median(dur) FILTER (WHERE device = 'device' AND category = 'comm') AS cmed, coalesce(sum(dur) FILTER (WHERE device = 'device' AND category = 'copy' AND subtype = 'd2h'), 0) AS d2h,
  coalesce(sum(dur) FILTER (WHERE device = 'device' AND category = 'copy' AND subtype = 'h2d'), 0) AS h2d, coalesce(sum(dur) FILTER (WHERE device = 'host' AND category = 'copy'), 0) AS hy, median(dur) FILTER (WHERE device = 'device' AND category = 'compute') AS kmed, coalesce(bool_or(device = 'device' AND category = 'compute' AND subtype = 'attention'), false) AS att,
  count(*) FILTER (WHERE device = 'host') AS disp, count(*) FILTER (WHERE device = 'host' AND name LIKE '%item%') AS sn, coalesce(sum(dur) FILTER (WHERE device = 'host' AND name LIKE '%item%'), 0) AS su FROM es GROUP BY scope),
x AS (SELECT sc.scope, phase, CAST(greatest(1, we - ws) AS DOUBLE) AS wall, steps, sm.* EXCLUDE (scope), bz.left_us AS db, bz.right_us AS hb, bz.right_only_us AS ho, bz.left_only_us AS dox, cm.left_us AS cu, cm.both_us AS co, cm.left_only_us AS ce, coalesce(idle, 0) AS idle, coalesce(gmax, 0) AS gmax, coalesce(gn, 0) AS gn
  FROM sc JOIN sm USING (scope) JOIN bz USING (scope) JOIN cm USING (scope) LEFT JOIN gs USING (scope)),
ib AS (SELECT scope, phase, {js('wall')} AS wallUs, n AS eventCount, dn AS deviceEventCount, {js(pct('db', 'wall'))} AS deviceBusyPct, {js(pct('hb', 'wall'))} AS hostBusyPct, {js(pct('idle', 'wall'))} AS idlePct, {js(pct('ho', 'wall'))} AS hostOnlyPct, {js(pct('dox', 'wall'))} AS deviceOnlyPct,
  {js(pct('cu', 'greatest(1, db)'))} AS commPctOfDevice, {js(pct('ce', 'wall'))} AS commExposedPct, {js(pct('co', 'greatest(1, cu)'))} AS commOverlapPct, {js('CAST(cn AS DOUBLE) / steps')} AS commPerStep, {js('CAST(cu AS DOUBLE) / steps')} AS commUsPerStep, {js('cmed')} AS commLatencyMedianUs,
  {js('ku')} AS computeUs, {js(pct('ku', 'wall'))} AS computePct, {js('yu')} AS copyUs, {js(pct('yu', 'wall'))} AS copyPct, {js('CAST(d2h AS DOUBLE) / steps')} AS d2hPerStepUs, {js('hs')} AS hostScheduleUs, {js('CAST(disp AS DOUBLE) / steps', 1)} AS dispatchPerStep, {js('su')} AS hostSyncUs, sn AS hostSyncCount,
  {js('CAST(sn AS DOUBLE) / steps')} AS hostSyncPerStep, {js('CAST(ho AS DOUBLE) / steps')} AS hostExclusivePerStepUs, {js('CAST(idle AS DOUBLE) / greatest(1, gn)')} AS meanGapUs, gn AS gapCount, {js('wall / steps')} AS avgStepUs, {js('ce')} AS commExposedUs,
  {js('CAST(h2d AS DOUBLE) / steps')} AS h2dPerStepUs, {js(pct('hy', 'greatest(1, hb)'))} AS hostCopyPctOfHost, {js('kmed')} AS medianComputeUs, att AS hasAttention, steps AS stepCount FROM x),
ix AS (SELECT *, CAST(NULL AS DOUBLE) AS mac, CAST(NULL AS DOUBLE) AS mte2, CAST(NULL AS DOUBLE) AS commSizeMedianMb, true AS phaseMix, 'low' AS phaseConfidence, false AS missingTables FROM ib)"""
_IND = ["wallUs", "eventCount", "deviceEventCount", "deviceBusyPct", "hostBusyPct", "idlePct", "hostOnlyPct", "deviceOnlyPct", "commPctOfDevice", "commExposedPct", "commOverlapPct", "commPerStep", "commUsPerStep", "commLatencyMedianUs", "computeUs", "computePct", "copyUs", "copyPct", "d2hPerStepUs", "hostScheduleUs",
        "dispatchPerStep", "hostSyncUs", "hostSyncCount", "hostSyncPerStep", "hostExclusivePerStepUs", "meanGapUs", "gapCount", "avgStepUs", "commExposedUs", "h2dPerStepUs", "hostCopyPctOfHost", "medianComputeUs", "hasAttention", "stepCount"]


@query("indicators", f"{_SC} SELECT * FROM ib")
def indicators(spark, d):
    return _blocks(spark, d).select("scope", "phase", *_IND)


def _sev(v: str, gate: float) -> str:
    return f"(CASE WHEN {v} >= {gate} THEN 0.5 + 0.5 * least(1.0, greatest(0.0, ({v} - {gate}) / {gate})) ELSE 0.0 END)"


_SCORE = f"""{_SC}, s4 AS (SELECT *, CASE WHEN hostOnlyPct >= 25 OR idlePct >= 8 THEN 45 * greatest({_sev('hostOnlyPct', 25.0)}, {_sev('idlePct', 8.0)}) + CASE WHEN dispatchPerStep >= 1200 OR hostExclusivePerStepUs >= 800 THEN 35 * greatest({_sev('dispatchPerStep', 1200.0)}, {_sev('hostExclusivePerStepUs', 800.0)}) ELSE 0 END + 20 * {_sev('hostBusyPct', 45.0)} ELSE 0 END AS host,
  CASE WHEN deviceBusyPct >= 82 AND computePct >= 55 THEN 55 * greatest({_sev('deviceBusyPct', 82.0)}, {_sev('computePct', 55.0)}) + CASE WHEN commExposedPct < 12 THEN 25 ELSE 0 END ELSE 0 END AS compute,
  CASE WHEN commPctOfDevice >= 12 AND commExposedPct >= 5 THEN 55 * greatest({_sev('commPctOfDevice', 12.0)}, {_sev('commExposedPct', 5.0)}) + CASE WHEN commLatencyMedianUs <= 60 THEN 20 ELSE 0 END + CASE WHEN commOverlapPct < 40 THEN 15 ELSE 0 END ELSE 0 END AS comm,
  CASE WHEN copyPct >= 4 OR d2hPerStepUs >= 200 THEN 45 * greatest({_sev('copyPct', 4.0)}, {_sev('d2hPerStepUs', 200.0)}) + CASE WHEN hostSyncCount > 0 THEN 12 * least(1.0, hostSyncPerStep) ELSE 0 END ELSE 0 END AS copy FROM ib),
cd AS (SELECT scope, phase, unnest(['host', 'compute', 'comm', 'copy']) AS bottleneck, unnest([{js('least(100, host)', 1)}, {js('least(100, compute)', 1)}, {js('least(100, comm)', 1)}, {js('least(100, copy)', 1)}]) AS score, unnest([0, 1, 2, 3]) AS i FROM s4),
rk AS (SELECT scope, phase, bottleneck, score, CAST(row_number() OVER (PARTITION BY scope ORDER BY score DESC, i) AS INTEGER) AS place FROM cd)"""


@query("bottleneck_scores", f"{_SCORE} SELECT * FROM rk")
def bottleneck_scores(spark, d):
    return A.candidates(_blocks(spark, d))


@query("verdict", f"{_SCORE} SELECT scope, phase, CASE WHEN score >= 40 THEN bottleneck ELSE 'balanced' END AS bottleneck, score FROM rk WHERE place = 1")
def verdict(spark, d):
    return A.verdicts(_blocks(spark, d))


@query("headline", f"{_SCORE} SELECT scope, phase, CASE WHEN score >= 40 THEN bottleneck ELSE 'balanced' END AS bottleneck, score FROM rk WHERE place = 1 ORDER BY score DESC, scope LIMIT 1")
def headline(spark, d):
    return A.headline(_blocks(spark, d))


_GATES = [(r, m, *A.rules.THRESHOLDS[r]) for r, m in A.GATES]
_EVID = f"{_SC}, evd AS (SELECT scope, unnest([{', '.join(repr(g[0]) for g in _GATES)}]) AS rule, unnest([{', '.join(f'CAST({g[1]} AS DOUBLE)' for g in _GATES)}]) AS value, unnest([{', '.join(f'coalesce({g[1]} {g[3]} {g[2]}, false)' for g in _GATES)}]) AS crossed, unnest([{', '.join(f'{g[2]}::DOUBLE' for g in _GATES)}]) AS threshold FROM ib)"


@query("evidence_long", f"{_EVID} SELECT * FROM evd")
def evidence_long(spark, d):
    return A.evidence(_blocks(spark, d)).select("scope", "rule", "value", "crossed", "threshold")


@query("evidence_missing", f"{_EVID} SELECT scope, count(*) AS n, string_agg(rule, ',' ORDER BY rule) AS rules FROM evd WHERE NOT crossed GROUP BY scope")
def evidence_missing(spark, d):
    return A.missing(_blocks(spark, d)).groupBy("scope").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("rule")), ",").alias("rules"))


_CAUSE = f"""{_SCORE}, hit AS (SELECT scope, phase, bottleneck FROM rk WHERE score >= 40), tr AS (
SELECT scope, 'host' AS bottleneck, 'host.eager-python-per-token' AS cause FROM ib WHERE phase = 'decode' AND dispatchPerStep >= 400 AND deviceBusyPct < 95 UNION ALL SELECT scope, 'host', 'host.sampler-sync' FROM ib WHERE hostSyncCount > 0 AND (hostSyncPerStep >= 0.5 OR hostSyncUs >= wallUs * 0.03)
UNION ALL SELECT scope, 'host', 'host.prefill-metadata' FROM ib WHERE phase = 'prefill' AND hostOnlyPct >= 15 AND dispatchPerStep >= 300 UNION ALL SELECT scope, 'host', 'host.launch-gaps' FROM ib WHERE gapCount >= 5 AND meanGapUs >= 80 AND idlePct >= 5
UNION ALL SELECT scope, 'comm', 'comm.decode-tp-small-message' FROM ib WHERE phase = 'decode' AND commPctOfDevice >= 12 AND commLatencyMedianUs <= 120 UNION ALL SELECT scope, 'comm', 'comm.prefill-bandwidth' FROM ib WHERE phase = 'prefill' AND commPctOfDevice >= 12
UNION ALL SELECT scope, 'comm', 'comm.overlap-disabled' FROM ib WHERE commPctOfDevice >= 8 AND commOverlapPct < 40 UNION ALL SELECT scope, 'copy', 'copy.d2h-sync-sampling' FROM ib WHERE d2hPerStepUs >= 150 OR hostSyncCount > 0 UNION ALL SELECT scope, 'copy', 'copy.h2d-kv-or-weight' FROM ib WHERE h2dPerStepUs >= 200
UNION ALL SELECT scope, 'compute', 'compute.prefill-attention-quadratic' FROM ib WHERE phase = 'prefill' AND computePct >= 55 AND hasAttention UNION ALL SELECT scope, 'compute', 'compute.decode-memory-bound' FROM ib WHERE phase = 'decode' AND deviceBusyPct >= 70
UNION ALL SELECT scope, 'compute', 'compute.fragmented-small-ops' FROM ib WHERE deviceBusyPct >= 70 AND computePct >= 40 AND medianComputeUs > 0 AND medianComputeUs < 30)
SELECT hit.scope, hit.phase, hit.bottleneck, coalesce(cause, hit.bottleneck || '.generic') AS cause FROM hit LEFT JOIN tr ON hit.scope = tr.scope AND hit.bottleneck = tr.bottleneck"""


@query("root_causes", _CAUSE)
def root_causes(spark, d):
    return A.causes(_blocks(spark, d))


_TRIG = ", ".join(f"('{k}', '{m}', CAST({m} AS DOUBLE), {t or 'true'})" for k, ms in A.rules.TRIGGERS.items() for m, t in ms)


@query("cause_triggers", f"{_CAUSE.replace('SELECT hit.scope, hit.phase', ', cau AS (SELECT hit.scope, hit.phase')}), tg AS (SELECT scope, t.* FROM ix, LATERAL (SELECT * FROM (VALUES {_TRIG}) AS v(kind, metric, v, ok)) AS t) SELECT cau.scope, cause, metric, CASE WHEN v IS NOT NULL THEN {js('v')} END AS value FROM cau JOIN tg ON cau.scope = tg.scope AND tg.kind = split_part(cause, '.', 1) AND ok")
def cause_triggers(spark, d):
    """The measures behind each cause."""
    block = _blocks(spark, d)
    return A.triggers(A.causes(block), block).select("scope", "cause", "metric", "value")


@query("analysis_warnings", f"{_SCORE}, wn AS (SELECT 'phases' AS warning, 'phases are told apart with low confidence' AS detail FROM ix WHERE scope = 'overall' AND phaseConfidence = 'low' UNION ALL SELECT 'steps', 'a single step was found' FROM ix WHERE scope = 'overall' AND stepCount <= 1 UNION ALL SELECT 'utilisation', 'no utilisation of operators' FROM ix WHERE scope = 'overall' AND mac IS NULL AND mte2 IS NULL), nb AS (SELECT scope FROM rk GROUP BY scope HAVING max(score) < 40) SELECT * FROM wn UNION ALL SELECT 'no bottleneck', string_agg(scope, ', ' ORDER BY scope) FROM nb HAVING count(*) > 0")
def analysis_warnings(spark, d):
    block = _blocks(spark, d)
    return A.warnings(block, A.candidates(block))


def _advice_row(item) -> str:
    """Oracle's rows of one advice template over ``ix``."""
    name, kind, phase, level, test, gain, low = item
    careful = js(low, 1) if low else js(f"{js(gain, 1)} * 0.5", 1)
    return f"SELECT scope, '{name}' AS advice, '{kind}' AS bottleneck, {level} AS level, {js(gain, 1)} AS gain_pct, {careful} AS low_pct FROM ix WHERE '{phase}' IN ('both', phase) AND coalesce({test}, false)"


_ADV = f"{_SCORE}, adv AS ({' UNION ALL '.join(map(_advice_row, A.rules.ADVICE))}), ad AS (SELECT adv.scope, advice, adv.bottleneck, level, gain_pct, low_pct, {js('level * 20 + least(40.0, coalesce(score, 0) * 0.4) + least(20.0, gain_pct * 0.4)')} AS priority FROM adv LEFT JOIN rk ON adv.scope = rk.scope AND adv.bottleneck = rk.bottleneck WHERE adv.bottleneck = 'balanced' OR score >= 40)"


@query("advice_ranked", f"{_ADV} SELECT * FROM ad")
def advice_ranked(spark, d):
    return A.advice(_blocks(spark, d))


@query("advice_levels", f"{_ADV}, o AS (SELECT advice, max(level) AS level, max(priority) AS p FROM ad GROUP BY advice) SELECT level, string_agg(advice, ',' ORDER BY p DESC, advice) AS items FROM o GROUP BY level")
def advice_levels(spark, d):
    return A.by_level(A.advice(_blocks(spark, d))).select("level", F.array_join("items", ",").alias("items"))


@query("top_actions", f"{_ADV} SELECT advice, max(priority) AS priority FROM ad GROUP BY advice ORDER BY priority DESC, advice LIMIT 3")
def top_actions(spark, d):
    return A.top_actions(A.advice(_blocks(spark, d))).select("advice", "priority")


_GAIN = """WITH a AS (SELECT p_size AS id, max(p_retailprice) / 100 AS g FROM part GROUP BY p_size HAVING p_size <= 8)"""


@query("gains_combined", f"{_GAIN} SELECT count(*) AS items, {js('least(70, sum(' + js('g', 1) + '))', 1)} AS optimistic_pct, {js('least(50, sum(' + js(js('g', 1) + ' * 0.5', 1) + '))', 1)} AS conservative_pct FROM a WHERE g > 0")
def gains_combined(spark, d):
    a = table(spark, d, "part").where("p_size <= 8").groupBy(F.col("p_size").cast("string").alias("advice")).agg((F.max("p_retailprice") / 100).alias("g"))
    found = a.select("advice", F.lit("overall").alias("scope"), F.lit(1.0).alias("priority"), S.round_half_up("g", 1).alias("gain_pct"), S.round_half_up(S.round_half_up("g", 1) * 0.5, 1).alias("low_pct"))
    return A.combined_gains(found)


@query("merged_advice", f"{_ADV} SELECT advice, max(priority) AS priority, max(gain_pct) AS gain_pct, max(low_pct) AS low_pct, string_agg(DISTINCT scope, ',' ORDER BY scope) AS scopes FROM ad GROUP BY advice")
def merged_advice(spark, d):
    return A.merged_advice(A.advice(_blocks(spark, d)))


# --- comparison ---------------------------------------------------------------------------------------------------------------


def _halves(spark, d):
    ev = events(spark, d)
    return ev.where(f"(ts div {DAY}) % 2 = 0"), ev.where(f"(ts div {DAY}) % 2 = 1")


_METRICS = f"""mt AS (SELECT unnest([{', '.join(repr(m) for m, _ in A.rules.METRICS)}]) AS metric, unnest([{', '.join(f'CAST({m} AS DOUBLE)' for m, _ in A.rules.METRICS)}]) AS v, unnest([{', '.join(repr(w) for _, w in A.rules.METRICS)}]) AS direction, scope FROM ib),
mp AS (SELECT metric, direction, max(v) FILTER (WHERE scope = 'overall') AS before, max(v) FILTER (WHERE scope = 'decode') AS after FROM mt GROUP BY ALL), mq AS (SELECT *, CASE WHEN before = 0 THEN CASE WHEN after = 0 THEN 0.0 END ELSE (after - before) / abs(before) * 100 END AS dp FROM mp),
mx AS (SELECT metric, before, after, {js('after - before')} AS delta_abs, CASE WHEN dp IS NOT NULL THEN {js('dp', 1)} END AS delta_pct, CASE WHEN dp IS NULL THEN NULL WHEN direction = 'higher' THEN {js('dp', 1)} ELSE {js('-dp', 1)} END AS improvement_pct, direction,
  CASE WHEN dp IS NULL OR direction = 'neutral' THEN NULL WHEN abs(dp) < 1 THEN false WHEN direction = 'lower' THEN dp < 0 ELSE dp > 0 END AS improved FROM mq)"""


@query("compare_metrics", f"{_SC}, {_METRICS} SELECT * FROM mx")
def compare_metrics(spark, d):
    b = _blocks(spark, d)
    return A.compared_metrics(b.where("scope = 'overall'"), b.where("scope = 'decode'"))


@query("metric_descriptions", f"SELECT unnest([{', '.join(repr(m) for m, _ in A.rules.METRICS)}]) AS metric, unnest([{', '.join(repr('%' if 'Pct' in m else 'us' if m.endswith('Us') else '') for m, _ in A.rules.METRICS)}]) AS unit, unnest([{', '.join(repr(w) for _, w in A.rules.METRICS)}]) AS direction")
def metric_descriptions(spark, d):
    return A.described_metrics(spark).select("metric", "unit", "direction")


_CMP = f"{EV}, b AS (SELECT name, category, dur FROM ev WHERE (ts // {DAY}) % 2 = 0), a AS (SELECT name, category, dur FROM ev WHERE (ts // {DAY}) % 2 = 1)"


@query("compare_categories", f"{_CMP}, x AS (SELECT category, CAST(sum(dur) AS BIGINT) AS u FROM b GROUP BY 1), y AS (SELECT category, CAST(sum(dur) AS BIGINT) AS u FROM a GROUP BY 1) SELECT coalesce(x.category, y.category) AS category, coalesce(x.u, 0) AS before_us, coalesce(y.u, 0) AS after_us, coalesce(y.u, 0) - coalesce(x.u, 0) AS delta_us FROM x FULL JOIN y ON x.category = y.category")
def compare_categories(spark, d):
    b, a = _halves(spark, d)
    side = lambda x: x.groupBy(F.col("category").alias("name")).agg(F.sum("dur").alias("total_us"))
    return A.compared_operators(side(b), side(a)).selectExpr("name as category", "before_us", "after_us", "delta_us")


@query("compare_operators", f"{_CMP}, x AS (SELECT name, CAST(sum(dur) AS BIGINT) AS u FROM b GROUP BY 1), y AS (SELECT name, CAST(sum(dur) AS BIGINT) AS u FROM a GROUP BY 1), z AS (SELECT coalesce(x.name, y.name) AS name, coalesce(x.u, 0) AS before_us, coalesce(y.u, 0) AS after_us, coalesce(y.u, 0) - coalesce(x.u, 0) AS delta_us FROM x FULL JOIN y ON x.name = y.name) SELECT *, CASE WHEN delta_us < -1 THEN 'improved' WHEN delta_us > 1 THEN 'regressed' ELSE 'unchanged' END AS verdict FROM z WHERE before_us <> 0 OR after_us <> 0")
def compare_operators(spark, d):
    b, a = _halves(spark, d)
    return A.compared_operators(D.operator_stats(b), D.operator_stats(a))


@query("operators_saved", f"{_CMP}, x AS (SELECT name, CAST(sum(dur) AS BIGINT) AS u FROM b GROUP BY 1), y AS (SELECT name, CAST(sum(dur) AS BIGINT) AS u FROM a GROUP BY 1), z AS (SELECT coalesce(x.name, y.name) AS name, coalesce(y.u, 0) - coalesce(x.u, 0) AS delta_us FROM x FULL JOIN y ON x.name = y.name) SELECT name, delta_us FROM z WHERE delta_us < -1 ORDER BY delta_us, name LIMIT 8")
def operators_saved(spark, d):
    return compare_operators(spark, d).where("verdict = 'improved'").orderBy("delta_us", "name").limit(8).select("name", "delta_us")


_FIRST = " ".join(f"WHEN '{a}' THEN '{ms[0]}'" for a, ms in A.rules.ADVICE_TARGETS.items() if ms)
_VERIFIED = f"""{_ADV}, {_METRICS}, mg AS (SELECT advice, max(gain_pct) AS g FROM ad WHERE scope = 'overall' GROUP BY advice), lt AS (SELECT DISTINCT advice FROM ad WHERE scope = 'decode'),
tg AS (SELECT advice, g, CASE advice {_FIRST} END AS metric FROM mg), vf AS (SELECT tg.advice, tg.metric, g AS expected_pct, improvement_pct AS observed_pct, {js('greatest(1.0, g * 0.5)', 1)} AS threshold_pct,
  CASE WHEN tg.advice LIKE 'common.%' OR improvement_pct IS NULL THEN 'unknown' WHEN improvement_pct >= {js('greatest(1.0, g * 0.5)', 1)} THEN 'achieved' WHEN improvement_pct > 0 THEN 'partial' ELSE 'missed' END AS verdict, lt.advice IS NOT NULL AS still_recommended
  FROM tg LEFT JOIN mx ON tg.metric = mx.metric LEFT JOIN lt ON tg.advice = lt.advice)"""


def _verified(spark, d):
    block = _blocks(spark, d)
    before, after = block.where("scope = 'overall'"), block.where("scope = 'decode'")
    metrics = A.compared_metrics(before, after)
    return before, after, metrics, A.verified_advice(A.merged_advice(A.advice(before)), metrics, A.merged_advice(A.advice(after)))


@query("advice_verdicts", f"{_VERIFIED} SELECT * FROM vf")
def advice_verdicts(spark, d):
    """What became of the advice of the whole capture in its second half."""
    return _verified(spark, d)[3]


_VB = "(SELECT CASE WHEN score >= 40 THEN bottleneck ELSE 'balanced' END FROM rk WHERE place = 1 AND scope = '{}')"


@query("compare_headline", f"""{_VERIFIED}, h AS (SELECT max(before) FILTER (WHERE metric = 'avgStepUs') AS step_before_us, max(after) FILTER (WHERE metric = 'avgStepUs') AS step_after_us, max(delta_pct) FILTER (WHERE metric = 'avgStepUs') AS step_pct, bool_or(improved) FILTER (WHERE metric = 'avgStepUs') AS step_improved,
max(before) FILTER (WHERE metric = 'deviceBusyPct') AS busy_before_pct, max(after) FILTER (WHERE metric = 'deviceBusyPct') AS busy_after_pct, max(delta_abs) FILTER (WHERE metric = 'deviceBusyPct') AS busy_delta_pts, max(improvement_pct) FILTER (WHERE metric = 'hostExclusivePerStepUs') AS host_exclusive_pct,
max(improvement_pct) FILTER (WHERE metric = 'dispatchPerStep') AS dispatch_pct FROM mx), n AS (SELECT count(*) FILTER (WHERE verdict = 'achieved') AS achieved, count(*) FILTER (WHERE verdict = 'missed') AS missed, count(*) FILTER (WHERE verdict = 'unknown') AS unknown FROM vf)
SELECT h.*, n.*, {_VB.format('overall')} <> {_VB.format('decode')} AS bottleneck_changed FROM h, n""")
def compare_headline(spark, d):
    before, after, metrics, verified = _verified(spark, d)
    return A.comparison_headline(metrics, verified, A.headline(before), A.headline(after)).drop("summary")


_SIDE = "SELECT count(DISTINCT ts // {day}) AS steps, CAST(max(te) - min(ts) AS DOUBLE) AS wall_us, {m1} AS compute_mix, list(DISTINCT CAST(k AS VARCHAR)) AS files, arg_max(category, ts) AS bottleneck FROM ev WHERE (ts // {day}) % 2 = {p}"
_MIX1 = "floor(CAST(sum(dur) FILTER (WHERE category = 'compute') AS DOUBLE) / sum(dur) * 100 * 10 + 0.5) / 10"


@query("comparability", f"""{EV}, b AS ({_SIDE.format(day=DAY, p=0, m1=_MIX1)}), a AS ({_SIDE.format(day=DAY, p=1, m1=_MIX1)}), x AS (SELECT abs((a.steps - b.steps) / CAST(b.steps AS DOUBLE) * 100) > 15 AS differs_steps, abs(a.compute_mix - b.compute_mix) > 10 AS differs_mix, false AS differs_override, true AS differs_sampled, false AS differs_source,
list_sort(a.files) <> list_sort(b.files) AS differs_files, a.bottleneck <> b.bottleneck AS differs_bottleneck, abs((a.wall_us - b.wall_us) / b.wall_us * 100) > 20 AS differs_window FROM a, b)
SELECT *, CAST(differs_steps AS INTEGER) + CAST(differs_mix AS INTEGER) + CAST(differs_files AS INTEGER) + 1 AS warnings, CASE WHEN NOT (differs_steps OR differs_mix OR differs_files) THEN 'medium' ELSE 'low' END AS level FROM x""")
def comparability(spark, d):
    """Odd days beside even ones; one side counts as sampled."""

    def side(x, sampled):
        share = "floor(sum(case when category = '{}' then dur end) / sum(dur) * 100 * 10 + 0.5) / 10"
        return x.agg(F.countDistinct(F.expr(f"ts div {DAY}")).alias("steps"), (F.max("te") - F.min("ts")).cast("double").alias("wall_us"), F.create_map(F.lit("prefill"), F.expr(share.format("compute"))).alias("mix"), F.lit("auto").alias("override"), F.lit(sampled).alias("sampled"), F.lit("trace").alias("source"), F.collect_set(F.col("k").cast("string")).alias("files"), F.max_by("category", "ts").alias("bottleneck"))

    b, a = _halves(spark, d)
    return A.comparability(side(b, False), side(a, True))


@query("compare_warnings", f"""{_VERIFIED}, mi AS (SELECT string_agg(metric, ', ' ORDER BY metric) AS d FROM mx WHERE metric LIKE '%Pct%' AND direction <> 'neutral' AND improvement_pct < 0), ms AS (SELECT string_agg(advice, ', ' ORDER BY advice) AS d FROM vf WHERE verdict = 'missed')
SELECT 'reversed shares' AS warning, d AS detail FROM mi WHERE d IS NOT NULL UNION ALL SELECT 'missed advice', d FROM ms WHERE d IS NOT NULL UNION ALL SELECT 'steps', ''""")
def compare_warnings(spark, d):
    """Warnings of a comparison in which the number of steps differs and nothing else."""
    _, _, metrics, verified = _verified(spark, d)
    checks = spark.range(1).selectExpr(*(f"{str(k == 'steps').lower()} as differs_{k}" for k, _, _ in A.CHECKS))
    return A.comparison_warnings(checks, metrics, verified)


@query("readable_values", """SELECT o_orderkey, CASE WHEN o_custkey * 10 < 1000 THEN printf('%.1f us', o_custkey * 10.0) ELSE printf('%.2f ms', o_custkey / 100.0) END AS us, printf('%.1f%%', o_custkey / 10.0) AS pct,
CASE WHEN o_custkey * 100 < 1000 THEN printf('%.0f', o_custkey * 100.0) ELSE printf('%.1fK', o_custkey / 10.0) END AS n, concat('[', o_custkey, 'x', o_orderkey, '] [7]') AS shape FROM orders""")
def readable_values(spark, d):
    """Times, shares, counts and shapes as text."""
    o = table(spark, d, "orders")
    return o.select("o_orderkey", S.format_us(F.col("o_custkey") * 10).alias("us"), S.format_pct(F.col("o_custkey") / 10).alias("pct"), S.format_count(F.col("o_custkey") * 100).alias("n"), S.format_shape(F.expr("concat(o_custkey, ',', o_orderkey, ';7')")).alias("shape"))


@query("file_symdiff", "SELECT 'before' AS side, n_name AS file FROM nation WHERE n_nationkey % 2 = 0 AND n_name NOT IN (SELECT n_name FROM nation WHERE n_nationkey % 3 = 0) UNION ALL SELECT 'after', n_name FROM nation WHERE n_nationkey % 3 = 0 AND n_name NOT IN (SELECT n_name FROM nation WHERE n_nationkey % 2 = 0)")
def file_symdiff(spark, d):
    n = table(spark, d, "nation")
    b, a = n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("file")), n.where("n_nationkey % 3 = 0").select(F.col("n_name").alias("file"))
    return b.exceptAll(a).selectExpr("'before' as side", "file").unionByName(a.exceptAll(b).selectExpr("'after' as side", "file"))


# --- view, kernels, sniffing, store -------------------------------------------------------------------------------------------

from spindrift.operators import view as V  # noqa: E402
from spindrift.sources import sniff as N  # noqa: E402

_BUDGET = f"""{_STAT}, w AS (SELECT device, name, count, total_us, least(count, greatest(20, CAST(floor(2000 * (CAST(total_us AS DOUBLE) / (SELECT sum(total_us) FROM stat))) AS BIGINT))) AS q FROM stat), h AS (SELECT *, count - q AS room, greatest(0, 2000 - CAST((SELECT sum(q) FROM w) AS BIGINT)) AS spare FROM w),
r AS (SELECT *, coalesce(sum(room) OVER (ORDER BY total_us DESC, device, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h) SELECT device, name, count, CAST(q + least(room, greatest(0, spare - before)) AS BIGINT) AS quota FROM r"""


@query("event_budget", _BUDGET)
def event_budget(spark, d):
    return V.event_budget(D.operator_stats(events(spark, d)), 2000, 20)


@query("view_events", f"{_BUDGET.replace('SELECT device, name, count, CAST(q', ', bq AS (SELECT device, name, CAST(q')}), o AS (SELECT ev.device, ev.name, idx, dur, quota, row_number() OVER (PARTITION BY ev.device, ev.name ORDER BY dur DESC, idx) AS n FROM ev JOIN bq ON ev.device = bq.device AND ev.name = bq.name) SELECT device, name, idx, dur FROM o WHERE n <= quota")
def view_events(spark, d):
    """The events that a page of 2,000 shows: the longest of each operator, as its quota allows."""
    ev = events(spark, d).select("device", "name", "idx", "dur", "stream", "rank", "category")
    return V.within_quota(ev.select("device", "name", "idx", "dur"), V.event_budget(D.operator_stats(ev), 2000, 20))


@query("page_gaps", f"{EV}, dv AS (SELECT * FROM ev WHERE device = 'device'), {isl('dv')}, pts AS (SELECT s, e FROM isl UNION ALL SELECT min(ts), min(ts) FROM ev UNION ALL SELECT max(te), max(te) FROM ev), g AS (SELECT e AS gap_start, lead(s) OVER (ORDER BY s, e) AS gap_end FROM pts) SELECT gap_start, gap_end, gap_end - gap_start AS dur FROM g WHERE gap_end > gap_start ORDER BY dur DESC, gap_start LIMIT 30")
def page_gaps(spark, d):
    """The thirty longest pauses of the device."""
    ev = events(spark, d)
    return V.page(ev, D.operator_stats(ev))["gaps"].selectExpr("start as gap_start", "`end` as gap_end", "dur")


@query("longest_per_lane", f"{EV} SELECT stream, idx, dur, CAST(row_number() OVER (PARTITION BY stream ORDER BY ts, idx) AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY dur DESC, idx) AS n FROM ev) WHERE n <= 25")
def longest_per_lane(spark, d):
    return V.longest_per_row(events(spark, d), ["stream"], 25).select("stream", "idx", "dur", "place")


@query("treemap")
def treemap(spark, d):
    return V.treemap(D.category_totals(events(spark, d)).selectExpr("'all' as scope", "category as item", "cast(total_us as double) as weight"), 1000.0, 600.0)


_VEC = "WITH v AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)"


@query("row_norm", f"{_VEC}, n AS (SELECT vec_id, sqrt(avg(x * x) + 1e-6) AS r FROM v GROUP BY vec_id) SELECT v.vec_id, {js('sum(x / r)', 6)} AS total, {js('max(x / r)', 6)} AS top FROM v JOIN n USING (vec_id) GROUP BY v.vec_id")
def row_norm(spark, d):
    n = V.row_norm(table(spark, d, "embeddings"), "embedding")
    return n.select("vec_id", S.round_half_up(F.expr("aggregate(out, 0D, (a, x) -> a + x)"), 6).alias("total"), S.round_half_up(F.array_max("out"), 6).alias("top"))


@query("quantize_roundtrip", f"{_VEC}, s AS (SELECT vec_id, max(abs(x)) / 127 AS s FROM v GROUP BY vec_id), q AS (SELECT vec_id, x, s, CASE WHEN s = 0 THEN 0 ELSE floor(x / s + 0.5) END AS q FROM v JOIN s USING (vec_id)) SELECT vec_id, {js('max(s)', 8)} AS scale, {js('max(abs(x - q * s))', 6)} AS worst, max(abs(x - q * s)) <= max(s) / 2 + 1e-12 AS in_bound FROM q GROUP BY vec_id")
def quantize_roundtrip(spark, d):
    q = V.quantized(table(spark, d, "embeddings"), "embedding")
    return q.select("vec_id", S.round_half_up("scale", 8).alias("scale"), S.round_half_up("worst", 6).alias("worst"), F.expr("worst <= scale / 2 + 1e-12D").alias("in_bound"))


@query("silu_chain", f"{_VEC} SELECT vec_id, {js('sum((x * x) / (1 + exp(-(x * x))))', 6)} AS total FROM v GROUP BY vec_id")
def silu_chain(spark, d):
    s = V.silu_product(table(spark, d, "embeddings").withColumn("b", F.col("embedding")), "embedding", "b")
    return s.select("vec_id", S.round_half_up(F.expr("aggregate(out, 0D, (a, x) -> a + x)"), 6).alias("total"))


@query("numeric_error", f"{_VEC}, s AS (SELECT vec_id, max(abs(x)) / 127 AS s FROM v GROUP BY vec_id), q AS (SELECT x, floor(x / s + 0.5) * s AS y FROM v JOIN s USING (vec_id)), r AS (SELECT sqrt(avg(x * x)) AS rms FROM q) SELECT {js('max(abs(x - y))', 6)} AS max_abs, {js('max(CASE WHEN abs(x) >= 0.01 * rms THEN abs(x - y) / abs(x) END)', 4)} AS max_rel, {js('any_value(rms)', 6)} AS rms FROM q, r")
def numeric_error(spark, d):
    q = V.quantized(table(spark, d, "embeddings"), "embedding").selectExpr("transform(embedding, x -> cast(x as double)) as expected", "back as actual")
    return V.numeric_error(q, "actual", "expected").select(S.round_half_up("max_abs", 6).alias("max_abs"), S.round_half_up("max_rel", 4).alias("max_rel"), S.round_half_up("rms", 6).alias("rms"))


@query("half_precision")
def half_precision(spark, d):
    """fp16 and bf16 rounding of every component."""
    return V.rounded(table(spark, d, "embeddings"), "embedding").selectExpr("vec_id", "f16", "b16")


@query("sniff_weights", """SELECT page_id, CAST(regexp_matches(url, '(?i)kernel_details.*\\.csv$') AS INTEGER) * 3 + CAST(regexp_matches(url, '(?i)trace_view\\.json$') AS INTEGER) * 2 AS weight FROM (SELECT page_id, concat(url, CASE page_id % 3 WHEN 0 THEN '/kernel_details_1.csv' WHEN 1 THEN '/trace_view.json' ELSE '' END) AS url FROM pages)
WHERE NOT regexp_matches(url, '(?i)_ascend_pt|npu|cann|hccl')""")
def sniff_weights(spark, d):
    p = table(spark, d, "pages").selectExpr("page_id", "concat(url, case page_id % 3 when 0 then '/kernel_details_1.csv' when 1 then '/trace_view.json' else '' end) as name", "'' as head")
    return N.sniffed(p).where("not name rlike '(?i)_ascend_pt|npu|cann|hccl'").selectExpr("page_id", "cast(name_weight as int) as weight")


@query("profile_verdict", """SELECT page_id % 10 AS set_id, CASE WHEN sum(CASE page_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 0 END) >= 4 THEN 'npu' ELSE 'unknown' END AS profile_type, bool_or(page_id % 3 < 2) AS ok FROM pages GROUP BY 1""")
def profile_verdict(spark, d):
    p = table(spark, d, "pages").selectExpr("page_id", "case page_id % 3 when 0 then 'kernel_details_1.csv' when 1 then 'trace_view.json' else 'x.txt' end as name", "'' as head")
    return N.validated(N.sniffed(p).withColumn("set_id", F.expr("page_id % 10")), ["set_id"]).selectExpr("set_id", "profile_type", "ok")


@query("lru_eviction", "SELECT id, last_access, place > 20 OR 30000 - last_access > 25000 AS evicted FROM (SELECT o_custkey AS id, max(o_orderkey) AS last_access, row_number() OVER (ORDER BY max(o_orderkey) DESC, o_custkey) AS place FROM orders WHERE o_custkey < 100 GROUP BY o_custkey)")
def lru_eviction(spark, d):
    e = table(spark, d, "orders").where("o_custkey < 100").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderkey").alias("last_access"))
    return D.evicted(e, 20, 25000, 30000)


@query("subtype_labels", f"{EV}, c AS (SELECT *, {_CLASS} FROM ev) SELECT op_category, subtype, CASE subtype WHEN 'allreduce' THEN 'all-reduce' WHEN 'd2h' THEN 'device to host' WHEN 'attention' THEN 'attention' WHEN 'matmul' THEN 'matrix multiply' WHEN 'other' THEN 'other compute' WHEN 'aten' THEN 'dispatch' ELSE 'other host work' END AS label, count(*) AS n FROM c GROUP BY ALL")
def subtype_labels(spark, d):
    c = events(spark, d).withColumn("c", S.classify("raw_name", "device")).groupBy(F.col("c.category").alias("op_category"), "c.subtype").agg(F.count("*").alias("n"))
    return c.select("op_category", "subtype", S.subtype_label("op_category", "subtype").alias("label"), "n")


@query("acceptance_thresholds", f"SELECT p_size AS expected, {js('greatest(1.0, p_size * 0.5)', 1)} AS threshold FROM (SELECT DISTINCT p_size FROM part)")
def acceptance_thresholds(spark, d):
    return table(spark, d, "part").select(F.col("p_size").alias("expected")).distinct().select("expected", S.acceptance_threshold("expected").alias("threshold"))


@query("table_kinds", "SELECT name, CASE WHEN name LIKE 'op_stat%' THEN 'op_statistic' WHEN name LIKE 'kernel%' THEN 'kernel_details' ELSE 'generic' END AS kind FROM (SELECT CASE s_suppkey % 3 WHEN 0 THEN 'op_statistic_' || s_suppkey || '.csv' WHEN 1 THEN 'kernel_details.csv' ELSE 'notes' || s_suppkey || '.csv' END AS name FROM supplier)")
def table_kinds(spark, d):
    n = table(spark, d, "supplier").selectExpr("case s_suppkey % 3 when 0 then concat('op_statistic_', s_suppkey, '.csv') when 1 then 'kernel_details.csv' else concat('notes', s_suppkey, '.csv') end as name")
    return n.select("name", S.table_kind("name").alias("kind"))
