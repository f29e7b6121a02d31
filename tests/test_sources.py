"""Readers: traces in any chunks and cut off, tables, records, archives, sniffing."""

from __future__ import annotations

import gzip
import io
import json
import struct
import tarfile
import zipfile

import pytest

from spindrift.functions import scalars as S
from spindrift.sources import csv_tables, json_ranges, records, sniff, trace_json

EVENTS = [
    {"ph": "M", "name": "process_name", "pid": 2, "args": {"name": "Ascend Hardware"}}, {"ph": "M", "name": "process_name", "pid": 1, "args": {"name": "Python"}},
    {"ph": "X", "name": "MatMul_1_0", "pid": 2, "tid": 7, "ts": "1704161511420306.491", "dur": 12.5, "args": {"Stream Id": "3", "Input Dims": [[1, 2], [3]], "Task Type": "AI_CORE"}},
    {"ph": "X", "name": "aten::add", "pid": 1, "tid": "t", "ts": "1704161511420300.000", "dur": "3.25", "cat": "cpu_op", "args": {"Call stack": "a \"quoted\" [text]"}},
    {"ph": "B", "name": "step", "pid": 1, "tid": "t", "ts": 1704161511420310}, {"ph": "E", "name": "step", "pid": 1, "tid": "t", "ts": 1704161511420350}, {"ph": "C", "name": "counter", "pid": 1, "ts": 1}, {"name": "late", "ts": 1704161511420400, "pid": 1},
]


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 13, 64, 10000])
@pytest.mark.parametrize("outer", [False, True])
def test_any_chunk_size(chunk, outer):
    text = json.dumps({"schema": 1.5, "traceEvents": EVENTS, "other": {"a": [1]}} if outer else EVENTS)
    scanner, found = trace_json.ElementScanner(), []
    for at in range(0, len(text), chunk):
        found += scanner.push(text[at : at + chunk])
    found += scanner.end()
    assert [json.loads(t) for _, t in found] == EVENTS and not scanner.truncated
    assert {k for k, _ in found} == {"traceEvents" if outer else ""} and (not outer or scanner.fields == {"schema": "1.5", "other": '{"a": [1]}'})


def test_cut_off_and_oversized():
    text = json.dumps(EVENTS)
    for cut in (len(text) - 1, len(text) - 5, text.index("aten::add")):
        found, scanner = trace_json.scan_text(text[:cut])
        assert scanner.truncated and [json.loads(t) for _, t in found] == EVENTS[: len(found)] and len(found) >= 3
    scanner = trace_json.ElementScanner(most_element=20)
    assert scanner.push('[{"a": 1}, {"b": "' + "x" * 100 + '"}, {"c": 2}]') == [("", '{"a": 1}'), ("", '{"c": 2}')] and scanner.oversized == 1
    assert trace_json.scan_text("[1, 2, true, null]")[0] == [("", "1"), ("", "2"), ("", "true"), ("", "null")]
    assert trace_json.scan_text("not json")[1].truncated


def _value(r, depth=0):
    k = r.random()
    if depth > 2 or k < 0.4:
        return r.choice([1, -2.5, True, None, 'a"b', "\\", '\\\\"', "}{][,", "é\U0001f600", "", " a  b "])
    if k < 0.7:
        return [_value(r, depth + 1) for _ in range(r.randint(0, 3))]
    return {r.choice(["k", 'x"y', "\\"]): _value(r, depth + 1) for _ in range(r.randint(0, 3))}


def _cut(text: bytes, cuts: list[int]) -> tuple[list, bool]:
    """Pieces of ranges cut anywhere, and whether the text stops short."""
    parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
    rows = []
    for i, part in enumerate(parts):
        s = json_ranges.Summary()
        for at in range(0, len(part), 7):
            s.push(part[at : at + 7])
        rows.append({"path": "f", "start": i * 10**6, "size": len(text), "read": s.size, "first": s.first, "states": s.states, "depths": s.depths})
    known, files = json_ranges.begins(rows)
    found = []
    for i, part in enumerate(parts):
        cutter = json_ranges.Cutter(*known["f", i * 10**6], i * 10**6)
        for at in range(0, len(part), 11):
            found += cutter.push(part[at : at + 11])
        found += [(*x[:1], x[1], x[2], x[3]) for x in cutter.end()]
    return found, files["f"][1]


def _elements(found: list) -> list[bytes]:
    held, out = None, []
    for _, kind, region, data in found:
        if kind == "whole":
            out.append(data)
        elif kind == "tail":
            held = [region, data]
        elif kind == "middle" and held:
            held[1] += data
        elif kind == "head" and held:
            out += [held[1] + data] if held[0] != -1 else []
            held = None
        elif kind == "end":
            break
    return [d.strip() for d in out if d.strip()]


def test_ranges_cut_anywhere_equal_one_piece():
    import random

    r = random.Random(0)
    for _ in range(600):
        elements = [_value(r) for _ in range(r.randint(0, 5))]
        text = json.dumps(elements, ensure_ascii=r.random() < 0.5, indent=r.choice([None, 1])).encode()
        cuts = sorted(r.sample(range(1, len(text)), min(len(text) - 1, r.randint(0, 6))))
        found, short = _cut(text, cuts)
        assert [json.loads(d) for d in _elements(found)] == elements and not short
        text = text[: r.randrange(1, len(text) + 1)]
        cuts = [c for c in cuts if c < len(text)]
        assert _elements(_cut(text, cuts)[0]) == _elements(_cut(text, [])[0])
        junk = b"[" + bytes(r.choice(b'[]{},"\\ a1') for _ in range(r.randint(1, 40)))
        cuts = sorted(r.sample(range(1, len(junk)), min(len(junk) - 1, 3)))
        assert _elements(_cut(junk, cuts)[0]) == _elements(_cut(junk, [])[0])


@pytest.mark.parametrize("size", [150, 1000, 1 << 27])
def test_files_in_byte_ranges(spark, tmp_path, size):
    import random

    r = random.Random(size)
    docs = {
        "bare.json": [_value(r) for _ in range(150)], "named.json": {"m": 1, "o": {"a": [1, 2], "b": {"c": "}"}}, "traceEvents": [{"e": _value(r)} for _ in range(120)], 'p"q': "x,y", "other": [{"z": 1}, 7]},
        "nested.json": {"deep": {str(i): [i, {"x": [i]}] for i in range(200)}, "traceEvents": [{"last": True}]}, "none.json": [],
    }
    for name, doc in docs.items():
        (tmp_path / name).write_text(json.dumps(doc, indent=1 if name == "named.json" else None))
    whole = json.dumps(EVENTS * 9)
    (tmp_path / "short.json").write_text(whole[: whole.rindex("aten::add")])
    (tmp_path / "word.json").write_text("not json")
    (tmp_path / "empty.json").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        rows = json_ranges.read_elements(spark, [str(tmp_path / n) for n in sorted(p.name for p in tmp_path.iterdir())]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = {}
    for x in sorted(rows, key=lambda x: (x["path"], x["seq"])):
        got.setdefault(x["path"].rsplit("/", 1)[1], []).append((x["key"], x["element"], x["truncated"]))
    parsed = {n: [(k, json.loads(e)) for k, e, cut in v if not cut] for n, v in got.items()}
    assert parsed["bare.json"] == [("", e) for e in docs["bare.json"]]
    assert parsed["named.json"] == [("traceEvents", e) for e in docs["named.json"]["traceEvents"]] + [("other", {"z": 1}), ("other", 7)]
    assert parsed["nested.json"] == [("traceEvents", {"last": True})] and "none.json" not in parsed
    short = EVENTS * 9
    assert parsed["short.json"] == [("", e) for e in short[: len(parsed["short.json"])]] and len(parsed["short.json"]) == 8 * len(EVENTS) + 3
    assert {n for n, v in got.items() if any(cut for *_, cut in v)} == {"short.json", "word.json"}


def test_trace_files(spark, tmp_path):
    (tmp_path / "rank_3_trace_view.json").write_text(json.dumps(EVENTS)[:-1])
    elements = trace_json.read_elements(spark, str(tmp_path), chunk=50)
    assert elements.where("element is not null").count() == len(EVENTS) and elements.where("truncated").count() == 1
    got = {r["name"]: r for r in trace_json.trace_events(elements).collect()}
    assert set(got) == {"MatMul_1_0", "aten::add", "step", "late"}
    m = got["MatMul_1_0"]
    assert (m["device"], m["stream"], m["normalized_name"], m["category"], m["subtype"], m["rank"], str(m["ts_us"]), m["dur_us"]) == ("device", "3", "MatMul", "compute", "matmul", "3", "1704161511420306.491", 12.5)
    assert json.loads(m["shapes_in"]) == [[1, 2], [3]] and m["task_type"] == "AI_CORE" and m["lane"] == "device:3"
    assert got["aten::add"]["device"] == "host" and got["aten::add"]["subtype"] == "aten" and got["step"]["dur_us"] == 40
    line = {r["raw_name"]: (r["ts"], r["te"]) for r in trace_json.timeline(trace_json.trace_events(elements)).collect()}
    assert line["aten::add"] == (0, 3) and line["MatMul_1_0"][0] == 6


def test_csv_tables(spark, tmp_path):
    (tmp_path / "kernel_details.csv").write_text('﻿Device_id,Name,Type,Start Time(us),Duration(us),Wait Time(ms),mac_ratio,mte2_ratio,Odd\n# note\n0,"Mat, ""Mul""",MatMulV2,"1,000.5",10,0.5,45%,N/A,keep\n1,,Add,2000,,1,0.3,0.1,--\n')
    rows = csv_tables.read_table(spark, str(tmp_path / "kernel_details.csv")).collect()
    assert [r["name"] for r in rows] == ['Mat, "Mul"', "Add"] and rows[0]["start_us"] == 1000.5 and rows[0]["wait_us"] == 500 and rows[0]["utilization"] == {"mac": 0.45}
    assert rows[0]["extra"] == {"col8": "keep"} and rows[1]["extra"] == {} and rows[0]["count"] == 1 and rows[1]["count"] is None and rows[0]["kind"] == "kernel_details"
    (tmp_path / "step_trace_time.csv").write_text("Device_id;Step;Computing;Communication(Not Overlapped);Free;Stage\n0;1;100;20;5.5;Prefill\n0;2;10;2;1;Decode\n")
    steps = csv_tables.read_table(spark, str(tmp_path / "step_trace_time.csv")).collect()
    assert [(r["name"], r["step_computing"], r["step_free"], r["step_stage"]) for r in steps] == [("Step 1", 100000, 5500, "Prefill"), ("Step 2", 10000, 1000, "Decode")]
    assert csv_tables.delimiter('a\tb\t"c,d,e,f"') == "\t" and csv_tables.unit_of("Time(ms)") == "ms" and csv_tables.metric_of("aic_mte2_time(us)") is None
    assert csv_tables.encoding_of("名称,类型".encode("gbk") * 20) == "GBK" and csv_tables.encoding_of("名称".encode()) == "UTF-8"


def field(number, wire, body):
    return bytes([number << 3 | wire]) + body


def vint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(name, start, dur):
    raw = name.encode()
    return field(1, 2, vint(len(raw)) + raw) + field(2, 0, vint(start)) + field(3, 0, vint(dur))


def test_records(spark, tmp_path):
    body = b"".join(vint(len(m)) + m for m in (message("MatMul", 5_000_000, 40), message("Add", 6_000_000, 7)))
    (tmp_path / "a.pb").write_bytes(body)
    (tmp_path / "b.bin").write_bytes(bytes([0xFF] * 8))
    got = sorted((r["name"], r["start_us"], r["dur_us"], r["confidence"]) for r in records.read_records(spark, str(tmp_path)).collect())
    assert got == [("Add", 6e6, 7, "low"), ("MatMul", 5e6, 40, "low")]
    mapped = records.read_records(spark, str(tmp_path), {"name": 1, "start": 2, "end": 3}, "*.pb").orderBy("idx").collect()
    assert mapped[0]["dur_us"] == 40 - 5_000_000 and mapped[0]["confidence"] == "mapped"
    nested = field(4, 2, vint(len(message("x", 1, 2))) + message("x", 1, 2)) + field(5, 1, struct.pack("<d", 2.5)) + field(6, 5, struct.pack("<f", 0.5))
    assert [(n, k) for n, k, _ in records.decode_message(nested)] == [(4, "message"), (5, "double"), (6, "float")]
    with pytest.raises(ValueError):
        records.decode_message(b"\x0a\xff\x01")
    assert records.split_records(b"\x05ab") == []


def test_archives_and_side_cars(spark, tmp_path):
    z, t = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(z, "w", zipfile.ZIP_DEFLATED) as f:
        f.writestr("d/op_statistic.csv", "OP Type,Count\nAdd,3\n")
    with tarfile.open(fileobj=t, mode="w:gz") as f:
        info = tarfile.TarInfo("x/trace_view.json")
        info.size = 2
        f.addfile(info, io.BytesIO(b"[]"))
    (tmp_path / "a.zip").write_bytes(z.getvalue())
    (tmp_path / "b.tar.gz").write_bytes(t.getvalue())
    (tmp_path / "communication.json").write_text('{"op": {"count": 1}}')
    (tmp_path / "bad.json").write_text("{nope")
    got = {r["name"]: bytes(r["content"]) for r in records.expand_archives(records.files(spark, str(tmp_path))).collect()}
    assert got["d/op_statistic.csv"].startswith(b"OP Type") and got["x/trace_view.json"] == b"[]" and len(got) == 4
    aux = {r["name"]: (r["kind"], r["entries"]) for r in records.read_aux(spark, str(tmp_path)).collect()}
    assert aux == {"communication.json": ("communication", 1), "bad.json": ("json-invalid", 0)}
    assert zipfile.ZipFile(io.BytesIO(records.write_zip([("a.txt", b"hi")]))).read("a.txt") == b"hi"


def test_archives_are_whole_or_an_error(monkeypatch):
    one, two = gzip.compress(b"[1, " * 50), gzip.compress(b"2]")
    assert list(records.members("t.json.gz", one + two + b"\0\0")) == [("t.json", b"[1, " * 50 + b"2]")]
    z, t = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(z, "w") as f, tarfile.open(fileobj=t, mode="w") as g:
        for k in range(3):
            f.writestr(f"{k}.csv", b"a" * 40)
            info = tarfile.TarInfo(f"{k}.csv")
            info.size = 40
            g.addfile(info, io.BytesIO(b"a" * 40))
    assert len(list(records.members("a.zip", z.getvalue()))) == len(list(records.members("a.tar", t.getvalue()))) == 3
    with pytest.raises(ValueError):
        list(records.members("cut.json.gz", one[:-9]))
    for limit, most in (("MOST_MEMBERS", 2), ("MOST_BYTES", 39)):
        with monkeypatch.context() as m:
            m.setattr(records, limit, most)
            for name, data in (("a.zip", z.getvalue()), ("a.tar", t.getvalue()), *([("t.json.gz", one)] if limit == "MOST_BYTES" else [])):
                with pytest.raises(ValueError):
                    list(records.members(name, data))


def test_sniffing(spark):
    rows = [("x/trace_view.json", '[{"ph": "X"'), ("kernel_details.csv", "a,b,c"), ("p.db", ""), ("junk", "\x01"), ("t.txt", "id,name,value"), ("r.pb", "")]
    kinds = {r["name"]: r["kind"] for r in sniff.sniffed(spark.createDataFrame(rows, "name string, head string")).collect()}
    assert kinds == {"x/trace_view.json": "trace-json", "kernel_details.csv": "kernel_details", "p.db": "sqlite", "junk": "unknown", "t.txt": "generic", "r.pb": "proto"}


def test_names_and_classes(spark):
    rows = [("hcom_allReduce__1234_0_1",), ("HcclAllReduce",), ("aten::add.Tensor",), ("MatMul_1_0",), ("foo_0123456789ab",), ("",), ("MatMul(x2)",), ("hcom_reduce_scatter_3",)]
    got = [r[0] for r in spark.createDataFrame(rows, "n string").select(S.normalize_name("n")).collect()]
    assert got == ["AllReduce", "AllReduce", "add", "MatMul", "foo", "(unnamed)", "MatMul", "ReduceScatter"]
    cases = [("MoeDispatch", "device", "compute", "moe"), ("moe_dispatch", "device", "comm", "alltoall"), ("aclrtMemcpyD2H", "host", "copy", "d2h"), ("execute_model", "host", "schedule", "engine"), ("aten::item", "host", "schedule", "aten"), ("RmsNorm", "device", "compute", "norm"), ("foo", "host", "schedule", "host-other")]
    got = [r[0] for r in spark.createDataFrame([c[:2] for c in cases], "n string, d string").select(S.classify("n", "d")).collect()]
    assert [(g["category"], g["subtype"]) for g in got] == [c[2:] for c in cases]
