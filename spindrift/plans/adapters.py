"""Driver tables in the shapes of a profiling capture.

``events`` become timed operators on a host and a device side (durations: value times ten seconds), ``lineitem`` with ``part`` an
instance table, ``orders`` a step table, ``embeddings`` vectors for numeric kernels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spindrift.functions import scalars as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """Rows of a table that is read by fewer tasks than there are cores, dealt out before costly expressions; larger tables stay as they are."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


#: Microseconds since 1970 of a timestamp without time zone, whatever the session's time zone.
MICROS = (
    "cast(extract(day from {0} - timestamp_ntz'1970-01-01 00:00:00') as bigint) * 86400000000 + cast(extract(hour from {0} - timestamp_ntz'1970-01-01 00:00:00') as bigint) * 3600000000"
    " + cast(extract(minute from {0} - timestamp_ntz'1970-01-01 00:00:00') as bigint) * 60000000 + cast(extract(second from {0} - timestamp_ntz'1970-01-01 00:00:00') * 1000000 as bigint)"
)
RAW_NAME = (
    "case event_id % 6 when 0 then concat('hcom_allReduce__', event_id, '_0_1') when 1 then concat('aten::', event_type, '_', user_id % 7, '_', event_id % 3) when 2 then concat('MatMul_', user_id % 7, '_0')"
    " when 3 then concat('MemcpyAsync_d2h_', event_id % 3) when 4 then concat('FlashAttentionScore_', user_id % 5) else 'aten::item.default' end"
)
DEVICE = "case when event_type in ('view', 'click') then 'host' else 'device' end"
CATEGORY = "case event_type when 'purchase' then 'compute' when 'signup' then 'comm' when 'error' then 'copy' else 'schedule' end"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx, ts, dur, te (microseconds), device, category, stream, rank, raw_name, name, k, user_id, event_type, value."""
    src = dealt(table(spark, sf_dir, "events")).selectExpr(
        "event_id as idx", f"{MICROS.format('ts')} as ts", "cast(round(value * 10000000) as bigint) as dur", f"{DEVICE} as device", f"{CATEGORY} as category", "user_id % 8 as stream", "user_id % 4 as rank",
        f"{RAW_NAME} as raw_name", "cast(get_json_object(props, '$.k') as bigint) as k", "user_id", "event_type", "value",
    )
    return src.withColumn("te", src["ts"] + src["dur"]).withColumn("name", S.normalize_name("raw_name"))


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An instance table: kind, name, device_id, dur_us, wait_us, mac, mte2 (from lineitem and part)."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice", "l_tax", "l_quantity", "l_discount")
    return line.join(part, line["l_partkey"] == part["p_partkey"]).selectExpr("p_type as name", "p_brand as brand", "l_suppkey % 8 as device_id", "cast(round(l_extendedprice * 100) as bigint) as dur_us", "cast(round(l_tax * 100) as bigint) as wait_us", "cast(l_quantity as bigint) as mac50", "cast(round(l_discount * 100) as bigint) as mte2_100")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step table, one row for each month: step (from 0), computing, comm, free in hundredths."""
    src = table(spark, sf_dir, "orders").selectExpr("year(o_orderdate) * 12 + month(o_orderdate) - 1 as m", "o_orderstatus as s", "cast(round(o_totalprice * 100) as bigint) as v")
    out = src.groupBy("m").agg(*(F_sum(code).alias(name) for code, name in (("F", "computing"), ("O", "comm"), ("P", "free"))))
    return out.selectExpr("cast(m as int) as month", "cast(row_number() over (order by m) - 1 as bigint) as step", "computing", "comm", "free")  # months only


def F_sum(code: str):
    from pyspark.sql import functions as F

    return F.coalesce(F.sum(F.expr(f"case when s = '{code}' then v end")), F.lit(0)).cast("long")


#: The same shapes in the oracle's SQL.
_N1 = "regexp_replace(regexp_replace(regexp_replace(trim(raw_name), '^(?:aten::|torch_npu::|torch::|vllm::|nn\\.modules?\\.|c10::|aclnn)', '', 'i'), '_[0-9a-f]{8,}$', '', 'i'), '(?:_+\\d+){1,4}$', '')"
EV = f"""WITH e0 AS (
  SELECT event_id AS idx, epoch_us(ts) AS ts, CAST(round(value * 10000000) AS BIGINT) AS dur, CASE WHEN event_type IN ('view', 'click') THEN 'host' ELSE 'device' END AS device,
    CASE event_type WHEN 'purchase' THEN 'compute' WHEN 'signup' THEN 'comm' WHEN 'error' THEN 'copy' ELSE 'schedule' END AS category, user_id % 8 AS stream, user_id % 4 AS rank,
    CASE event_id % 6 WHEN 0 THEN concat('hcom_allReduce__', event_id, '_0_1') WHEN 1 THEN concat('aten::', event_type, '_', user_id % 7, '_', event_id % 3) WHEN 2 THEN concat('MatMul_', user_id % 7, '_0')
      WHEN 3 THEN concat('MemcpyAsync_d2h_', event_id % 3) WHEN 4 THEN concat('FlashAttentionScore_', user_id % 5) ELSE 'aten::item.default' END AS raw_name,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, user_id, event_type, value FROM events
), e1 AS (SELECT *, ts + dur AS te, {_N1} AS n1 FROM e0),
e2 AS (SELECT *, CASE WHEN regexp_matches(n1, '^(?:hcom[_-]|hccl[_-]?)', 'i') THEN CASE WHEN regexp_matches(regexp_replace(n1, '^(?:hcom[_-]|hccl[_-]?)', '', 'i'), '^all[_-]?reduce', 'i') THEN 'AllReduce' ELSE regexp_replace(n1, '^(?:hcom[_-]|hccl[_-]?)', '', 'i') END ELSE n1 END AS n2 FROM e1),
ev AS (SELECT * EXCLUDE (n1, n2), CASE WHEN n3 = '' THEN '(unnamed)' ELSE n3 END AS name FROM (SELECT *, regexp_replace(regexp_replace(n2, '\\.(?:default|out|input|Tensor|Scalar)$', ''), '\\((?:x\\d+|\\d+)\\)$', '') AS n3 FROM e2))"""
INST = """WITH inst AS (
  SELECT p_type AS name, p_brand AS brand, l_suppkey % 8 AS device_id, CAST(round(l_extendedprice * 100) AS BIGINT) AS dur_us, CAST(round(l_tax * 100) AS BIGINT) AS wait_us, CAST(l_quantity AS BIGINT) AS mac50, CAST(round(l_discount * 100) AS BIGINT) AS mte2_100
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
STEPS = """WITH s0 AS (SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER) AS month, o_orderstatus AS s, CAST(round(o_totalprice * 100) AS BIGINT) AS v FROM orders),
st AS (SELECT month, row_number() OVER (ORDER BY month) - 1 AS step, CAST(coalesce(sum(CASE WHEN s = 'F' THEN v END), 0) AS BIGINT) AS computing, CAST(coalesce(sum(CASE WHEN s = 'O' THEN v END), 0) AS BIGINT) AS comm,
  CAST(coalesce(sum(CASE WHEN s = 'P' THEN v END), 0) AS BIGINT) AS free FROM s0 GROUP BY month)"""
