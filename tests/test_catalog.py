"""Every catalogue query against its SQL in DuckDB, on the smallest tables; those whose rules need more data also on the next size."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from spindrift.plans import catalog

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
RULES = ["indicators", "bottleneck_scores", "verdict", "headline", "evidence_long", "evidence_missing", "root_causes", "cause_triggers", "analysis_warnings", "advice_ranked", "advice_levels", "top_actions", "merged_advice", "compare_metrics", "advice_verdicts", "step_metrics", "step_containment", "gap_segments", "engine_steps"]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def opened(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def duck():
    return opened(SF)


@pytest.fixture(scope="module")
def larger():
    return opened(LARGER)


def cells(frame):
    """Rows as text, columns by name, in any order."""
    frame = frame[sorted(frame.columns)].astype(object)
    text = lambda v: "null" if pd.api.types.is_scalar(v) and pd.isna(v) else str(v) if isinstance(v, (bool, str)) else f"{float(v):.9g}" if hasattr(v, "__float__") else str(v)
    return sorted(tuple(text(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name not in catalog.ORACLES:
        assert len(got.columns) > 0
        return
    want = duck.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert cells(got) == cells(want)


@pytest.mark.parametrize("name", RULES)
def test_query_on_larger_tables(spark, larger, name):
    got = catalog.QUERIES[name](spark, LARGER).toPandas()
    assert cells(got) == cells(larger.sql(catalog.ORACLES[name]).df())
