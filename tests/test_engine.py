"""From files to verdicts: generated captures with a known bottleneck, comparison with itself, reports, streams, kernels."""

from __future__ import annotations

import json
import os
import random
import shutil
import subprocess
import sys
import zipfile
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spindrift import report
from spindrift.engine import Engine
from spindrift.operators import analysis as A
from spindrift.operators import view as V
from spindrift.streaming import live

#: steps, kernel length, communication length, host operators in a step, their length, pause of the device in a step
SCENARIOS = {"compute": (8, 900, 20, 20, 5, 0), "comm": (12, 60, 200, 20, 5, 0), "host": (8, 60, 10, 300, 14, 4000)}


def write(folder, name, seed=1):
    steps, kernel, comm, ops, each, pause = SCENARIOS[name]
    r, t, out = random.Random(seed), 1_700_000_000_000_000, [{"ph": "M", "name": "process_name", "pid": 2, "args": {"name": "NPU device"}}, {"ph": "M", "name": "process_name", "pid": 1, "args": {"name": "python"}}]
    for _ in range(steps):
        start = t
        for i in range(ops):
            out.append({"ph": "X", "name": f"aten::op{i % 7}", "pid": 1, "tid": 1, "ts": str(start + i * each), "dur": each * 0.9, "cat": "cpu_op"})
        t += pause
        for i in range(10):
            d = kernel + r.randrange(5)
            out.append({"ph": "X", "name": f"MatMul_{i}_0", "pid": 2, "tid": 5, "ts": str(t), "dur": d, "args": {"Stream Id": "5"}})
            out.append({"ph": "X", "name": f"hcom_allReduce__{i}_0_1", "pid": 2, "tid": 6, "ts": str(t + d), "dur": comm, "args": {"Stream Id": "6"}})
            t += d + comm
        t += 400
    (folder / "trace_view.json").write_text(json.dumps(out))
    rows = "".join(f"0,MatMul_{i}_0,MatMulV2,{kernel},0.72,0.3\n" for i in range(10))
    (folder / "kernel_details.csv").write_text("Device_id,Name,Type,Duration(us),mac_ratio,mte2_ratio\n" + rows)
    return str(folder)


@pytest.fixture(scope="module")
def captures(spark, tmp_path_factory):
    engine = Engine(spark)
    return engine, {k: engine.ingest(write(tmp_path_factory.mktemp(k), k), k) for k in SCENARIOS}


@pytest.mark.parametrize("name", list(SCENARIOS))
def test_scenario_verdict(captures, name):
    engine, found = captures
    best = engine.analyze(found[name])["verdicts"].where("scope = 'overall'").first()
    assert best["bottleneck"] == name and best["score"] >= 40


def test_comparison_with_itself_changes_nothing(captures):
    engine, found = captures
    c = engine.compare(found["comm"], found["comm"])
    assert {r["delta_pct"] for r in c["metrics"].collect()} <= {0.0, None} and not [r for r in c["metrics"].collect() if r["improved"]]
    assert {r["verdict"] for r in c["operators"].collect()} == {"unchanged"}


def test_comparison_sees_change(captures):
    engine, found = captures
    m = {r["metric"]: r for r in engine.compare(found["host"], found["compute"])["metrics"].collect()}
    assert m["hostExclusivePerStepUs"]["improved"] and m["deviceBusyPct"]["improved"]


def test_reports_and_export(captures, tmp_path):
    engine, found = captures
    text = engine.report(found["host"])
    assert "undefined" not in text and "NaN" not in text and "## Advice" in text and "host" in text
    assert "<table>" in report.html(text, "x")
    paths = engine.export(found["host"], str(tmp_path / "out"))
    assert len(paths) == 4 and json.load(open(paths[2]))["operators"]
    row = json.loads(engine.view(found["compute"], 100).first()["json"])
    assert row["events"] == sorted(row["events"], key=lambda e: e["ts"])
    advice = engine.analyze(found["host"])["advice"].first()["advice"]
    assert advice in open(engine.handoff(found["host"], advice, str(tmp_path / "task"))).read()


def test_refusals(spark, tmp_path):
    (tmp_path / "x.txt").write_text("hello")
    with pytest.raises(ValueError):
        Engine(spark).ingest(str(tmp_path))
    with pytest.raises(PermissionError):
        Engine(spark, ["/nowhere"]).ingest(str(tmp_path))
    (tmp_path / "y.db").write_bytes(b"SQLite format 3\0")
    with pytest.raises(ValueError):
        Engine(spark).ingest(str(tmp_path))


def test_a_folder_gives_its_known_files_and_tells_of_the_rest(spark, tmp_path):
    events = [{"ph": "X", "name": f"MatMul_{i}", "pid": 1, "tid": 1, "ts": i * 100, "dur": 50} for i in range(20)]
    for name in ("a_trace.json", "b_trace.json"):
        (tmp_path / name).write_text(json.dumps(events))
    (tmp_path / "c_trace.json").write_text(json.dumps(events) + " " * 5000)
    (tmp_path / "notes.md").write_text('[{"ph": "X"}]')
    capture = Engine(spark).ingest(str(tmp_path), max_files=1, max_bytes=4000)
    assert capture.events.count() == 20 and [r["name"] for r in capture.artifacts.collect()] == ["a_trace.json"]
    assert capture.notes == ["1 files left out: no known extension", "1 files left out: over 4000 bytes", "1 files left out: over 1 files"]
    (tmp_path / "odd.trace").write_text(json.dumps(events))
    assert Engine(spark).ingest(str(tmp_path / "odd.trace")).events.count() == 20


def test_options_of_the_engine(spark, tmp_path):
    work = [{"ph": "X", "name": f"MatMul_{i}", "pid": 1, "tid": 1, "ts": i * 100, "dur": 50, "args": {"flops": 2e9} if i % 2 else {}} for i in range(20)]
    (tmp_path / "a_trace.json").write_text(json.dumps(work))
    with_peak, without = Engine(spark, peak_tflops=80.0), Engine(spark)
    capture = with_peak.ingest(str(tmp_path))
    assert tuple(with_peak.utilisation(capture).first()) == (10, 40.0, 50.0)
    assert tuple(without.utilisation(capture).first()) == (10, 40.0, None)
    page = with_peak.page(capture, budget=5, operators=3, ranking=2, gaps=4)
    assert page["operators"].count() == 1 and page["gaps"].count() <= 4 and page["steps"].count() >= 1
    lane = page["lanes"].first()
    assert (len(lane["events"]), lane["count"], lane["truncated"]) == (8, 20, True)  # each lane has eight at least


def test_streams(spark, tmp_path):
    rows = [(k, int(s) * 1_000_000, 5_000_000) for k, s in [("a", 0), ("a", 3), ("a", 20), ("b", 1), ("a", 90000)]]
    pd.DataFrame(rows, columns=["k", "ts", "dur"]).to_parquet(tmp_path / "p.parquet")
    events = live.event_files(spark, str(tmp_path), "k string, ts long, dur long")
    q = live.busy_sessions(events, ["k"], late="1 second").writeStream.format("memory").queryName("busy").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = sorted((r["k"], r["start"] // 10**6, r["end"] // 10**6, r["n"]) for r in spark.table("busy").collect())
    assert got == [("a", 0, 8, 2), ("a", 20, 25, 1), ("b", 1, 6, 1)]


def test_stream_pairs(spark, tmp_path):
    marks = [("x", "B", 1, 0), ("x", "B", 5, 1), ("x", "E", 9, 2), ("x", "E", 11, 3), ("y", "E", 2, 4), ("y", "B", 3, 5)]
    pd.DataFrame(marks, columns=["key", "ph", "ts", "seq"]).to_parquet(tmp_path / "p.parquet")
    stream = live.event_files(spark, str(tmp_path), "key string, ph string, ts long, seq long")
    q = live.pair_ends(stream).writeStream.format("memory").queryName("pairs").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert [tuple(r) for r in spark.table("pairs").collect()] == [("x", 5, 4)]


def test_a_stream_that_is_stopped_goes_on_with_open_begins(spark, tmp_path):
    rng = np.random.default_rng(2)
    marks = [(f"k{rng.integers(4)}", rng.choice(["B", "E"]), 10**9 + int(i) * 1000, i) for i in range(120)]
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()

    def run():
        stream = live.event_files(spark, str(source), "key string, ph string, ts long, seq long")
        q = live.pair_ends(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(180) and q.exception() is None

    for part, name in ((marks[:61], "a.parquet"), (marks[61:], "b.parquet")):
        pd.DataFrame(part, columns=["key", "ph", "ts", "seq"]).to_parquet(source / name)
        run()
    want, begun = [], {}
    for key, ph, ts, _ in marks:
        if ph == "B":
            begun[key] = ts
        elif key in begun:
            want.append((key, begun[key], ts - begun.pop(key)))
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == sorted(want)


def test_half_precision_values():
    half = lambda x: float(np.float32(x).astype(np.float16))
    assert half(0.1) == 0.0999755859375 and np.isinf(np.float32(70000).astype(np.float16)) and half(65504) == 65504 and half(1e-8) == 0
    assert V.to_bfloat16(np.float32([1.0, 3.14159265]))[1] == 3.140625


def test_treemap_and_ticks():
    boxes = V.squarified([6, 6, 4, 3, 2, 2, 1, 0], 6, 4)
    assert abs(sum(w * h for *_, w, h in boxes) - 24) < 1e-9 and boxes[-1][2] == 0
    assert V.axis_ticks(0, 100, 5) == [0, 20, 40, 60, 80, 100]


def test_int8_error_is_half_a_step(spark):
    df = spark.createDataFrame([(1, [0.5, -1.0, 0.3]), (2, [0.0, 0.0])], "id int, v array<double>")
    for r in V.quantized(df, "v").collect():
        assert r["worst"] <= r["scale"] / 2 + 1e-12


def test_entry_points_without_the_training_data_part(tmp_path):
    """A copy without that part and its pipeline imports, and offers all the other queries."""
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) >= 100
    root = Path(e.__file__).parent
    shutil.copytree(root / "spindrift", tmp_path / "spindrift", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    told = "import __spark_entry__ as e, spindrift; print(spindrift.__file__); print(len(e.queries()), len(e.oracle_sql()), sum(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in e.queries()))"
    found = subprocess.run([sys.executable, "-c", told], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ""}, timeout=120, check=True).stdout.split("\n")
    assert found[0].startswith(str(tmp_path)) and int(found[1].split()[0]) >= 100 and found[1].split()[2] == "0"


def test_archive_gives_the_same_verdict_as_the_folder(spark, captures, tmp_path):
    folder = tmp_path / "plain"
    folder.mkdir()
    write(folder, "comm")
    (folder / "communication.json").write_text(json.dumps({"step": {"collective": 1}}))
    zipped = tmp_path / "zipped"
    zipped.mkdir()
    with zipfile.ZipFile(zipped / "capture.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(folder.iterdir()):
            z.write(f, f.name)
    engine = captures[0]
    one, two = engine.ingest(str(folder), "folder"), engine.ingest(str(zipped), "archive")
    assert one.events.count() == two.events.count() and set(two.tables) == set(one.tables) == {"kernel_details"}
    rows = lambda c: sorted(map(str, engine.analyze(c)["verdicts"].collect()))
    assert rows(one) == rows(two)
    assert [(r["kind"], r["entries"]) for r in two.aux.collect()] == [("communication", 1)]
    counts = {r["path"].rsplit("!", 1)[-1]: r["events"] for r in engine.lineage(two).collect()}
    assert counts["trace_view.json"] == two.events.count() and counts["communication.json"] == 0


def test_milliseconds_markers_and_phases(spark, tmp_path):
    """A trace in milliseconds, and a marker side-car that names phases."""
    out, marks, t = [{"ph": "M", "name": "process_name", "pid": 2, "args": {"name": "NPU device"}}], [], 5000.0
    for k in range(6):
        long = k % 3 == 0
        marks.append({"name": "prefill batch" if long else "decode token", "ts": t * 1000, "dur": 4000})
        for i in range(8):
            out.append({"ph": "X", "name": "MatMul", "pid": 2, "tid": 1, "ts": str(t + i * 0.05), "dur": 0.04 if long else 0.02, "args": {"Stream Id": "1"}})
        t += 5
    (tmp_path / "trace_view.json").write_text(json.dumps(out))
    (tmp_path / "mstx_marks.json").write_text(json.dumps(marks))
    engine = Engine(spark)
    c = engine.ingest(str(tmp_path), "ms")
    assert set(c.units.values()) == {"ms"} and c.events.agg(F.max("te")).first()[0] > 25_000
    assert c.step_source == "markers" and c.steps.count() == 6
    got = engine.phases(c).orderBy("step").collect()
    assert [r["phase"] for r in got] == ["prefill", "decode", "decode"] * 2 and {(r["method"], r["confidence"]) for r in got} == {("marker-labels", "high")}
    assert engine.indicators(c).where("scope = 'overall'").first()["phase"] in ("prefill", "decode")


def test_overrides_change_verdicts_and_are_checked(captures):
    engine, found = captures
    low = engine.analyze(found["compute"], thresholds={"deviceBusyGate": 1000.0})["candidates"].where("scope = 'overall' and bottleneck = 'compute'").first()
    assert low["score"] == 0
    with pytest.raises(KeyError):
        engine.analyze(found["compute"], thresholds={"nothing": 1.0})
    forced = engine.analyze(found["host"], phase="decode")["verdicts"].collect()
    assert [(r["scope"], r["phase"]) for r in forced] == [("decode", "decode")]
    assert engine.ingest(found["host"].artifacts.first()["path"].removeprefix("file:").rsplit("/", 1)[0], "sampled", sample_budget=100).sampled


def test_comparison_tells_what_differs(captures):
    engine, found = captures
    same = engine.compare(found["comm"], found["comm"])
    checks = same["comparability"].first()
    assert checks["level"] == "high" and not any(checks[f"differs_{k}"] for k, _, _ in A.CHECKS)
    other = engine.compare(found["host"], found["compute"], ("auto", "decode"))
    checks, head = other["comparability"].first(), other["headline"].first()
    assert checks["differs_override"] and checks["differs_bottleneck"] and checks["level"] != "high" and head["bottleneck_changed"] and "device busy" in head["summary"]
    assert "override" in [r["warning"] for r in other["warnings"].collect()]
    assert {r["verdict"] for r in other["advice"].collect()} <= {"achieved", "partial", "missed", "unknown"}
