"""Python API: ingest a capture, analyse it, compare two, report, export."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift import report
from spindrift.functions.tables import kept
from spindrift.operators import analysis as A
from spindrift.operators import dataset as D
from spindrift.operators import phases as P
from spindrift.operators import view as V
from spindrift.sources import csv_tables, json_ranges, records, sniff, trace_json


@dataclass
class Capture:
    """A data set: events with whole-microsecond times, table rows by kind, where steps came from, what files there were."""

    label: str
    events: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict)
    steps: DataFrame | None = None
    step_source: str = "window"
    artifacts: DataFrame | None = None
    markers: DataFrame | None = None
    aux: DataFrame | None = None
    sampled: bool = False
    units: dict[str, str] = field(default_factory=dict)
    notes: list[str] = field(default_factory=list)
    block: DataFrame | None = None


EMPTY = "path string, idx long, ts long, te long, dur long, device string, category string, subtype string, role string, name string, raw_name string, rank string, stream string"
TABLE_KINDS = {k for k, _ in csv_tables.rules.TABLE_KINDS} | {"generic"}


class Engine:
    """Entry points; frames stay lazy until a report or a decision needs a few rows.

    ``peak_tflops`` is a card's peak, for the share of it in ``utilisation``; ``top_n`` the operators of a report's ranking; ``proto_fields``
    the field numbers of record files (name, start, dur or end), without which they are recognised by likeness.
    """

    def __init__(self, spark: SparkSession, allowed: list[str] | None = None, peak_tflops: float | None = None, top_n: int = 20, proto_fields: dict[str, int] | None = None):
        self.spark, self.allowed, self.captures = spark, allowed, {}
        self.peak_tflops, self.top_n, self.proto_fields = peak_tflops, top_n, proto_fields

    def _guard(self, path: str) -> str:
        """Paths must be below an allowed folder, if folders are named."""
        real = os.path.realpath(path.removeprefix("file://"))
        if self.allowed and not any(real == os.path.realpath(a) or real.startswith(os.path.realpath(a) + os.sep) for a in self.allowed):
            raise PermissionError(f"{path} is outside the allowed folders")
        return path

    def ingest(self, path: str | list[str], label: str | None = None, sample_budget: int | None = None, ranks: str = "rebase", max_files: int | None = None, max_bytes: int | None = None) -> Capture:
        """Read every artifact below ``path`` (one or several): traces, tables, records, side-cars, also inside archives.

        Times of a trace that can only be milliseconds are read so. ``sample_budget`` keeps important and long events and a stride of
        the others; by default nothing is sampled. ``ranks`` is ``rebase`` (each rank from its first event) or ``raw``. Of a folder
        only files with a known extension are read; ``max_files`` (by path) and ``max_bytes`` (of a file) leave out more, by default
        nothing. What is left out is told in the capture's ``notes``. Raises ValueError if there is nothing to analyse.
        """
        paths = [self._guard(p) for p in ([path] if isinstance(path, str) else path)]
        files, notes = records.chosen(records.files(self.spark, paths), paths, max_files, max_bytes)
        found = sniff.sniffed(records.heads(self.spark, files)).drop("head")
        found = kept(found, "capture-files")
        if found.where("kind = 'archive'").limit(1).count():  # what they hold is written once and read like files
            inside = kept(records.expand_archives(files.join(F.broadcast(found.where("kind = 'archive'").select("path")), "path", "left_semi")).selectExpr("concat(archive, '!', name) as path", "length", "content"), "capture-members")
            files = files.select("path", "length", "content").join(F.broadcast(found.where("kind <> 'archive'").select("path")), "path", "left_semi").unionByName(inside)
            found = found.unionByName(sniff.sniffed(records.heads(self.spark, inside)).drop("head"))
            found = kept(found, "capture-files")
        kinds = [(r["path"], r["kind"]) for r in found.select("path", "kind").collect()]  # one row for each file
        if any(k == "sqlite" for _, k in kinds):
            raise ValueError("databases can't be read; export tables as CSV")
        verdict = sniff.validated(found.withColumn("__set", F.lit(1)), ["__set"]).first()
        if verdict is None or not verdict["ok"]:
            raise ValueError("no trace, table or record file of a capture here")
        of_kind = lambda kind: files.join(F.broadcast(found.where(F.col("kind") == kind).select("path")), "path", "left_semi")
        has = {k for _, k in kinds}
        capture = Capture(label or paths[0].rstrip("/").rsplit("/", 1)[-1], self.spark.createDataFrame([], EMPTY), artifacts=found, notes=notes)
        parts, origin = [], 0
        if "trace-json" in has:
            inner = of_kind("trace-json").where("contains(path, '!')")  # members of archives
            elements = [trace_json.read_elements(self.spark, files=inner)] if any("!" in p for p, k in kinds if k == "trace-json") else []
            plain = [p for p, k in kinds if k == "trace-json" and "!" not in p]
            elements += [json_ranges.read_elements(self.spark, plain)] if plain else []
            raw = kept(trace_json.trace_events(reduce(DataFrame.unionByName, elements)), "capture-trace")
            units = D.time_units(raw).collect()  # one row for each trace
            capture.units = {r["path"]: r["unit"] for r in units}
            raw = D.in_microseconds(raw, self.spark.createDataFrame(units, "path string, unit string"))
            origin = raw.agg(F.min("ts_us")).first()[0] or 0
            parts.append(trace_json.timeline(raw))
        if "proto" in has:
            r = records.read_records(self.spark, names=self.proto_fields, files=of_kind("proto"))
            r = r.selectExpr("path", "idx", "name as raw_name", "name", "cast(start_us as bigint) as ts", "cast(dur_us as bigint) as dur", "'host' as device", "'schedule' as category", "'host-other' as subtype", "'framework' as role", "cast(null as string) as rank", "cast(null as string) as stream")
            parts.append(r.withColumn("te", F.expr("ts + dur")))
        for where, kind in kinds:
            if kind in TABLE_KINDS:
                rows = csv_tables.read_table(self.spark, where, kind) if "!" not in where else csv_tables.read_member(files.where(F.col("path") == where), where, kind)
                capture.tables[kind] = capture.tables[kind].unionByName(rows, allowMissingColumns=True) if kind in capture.tables else rows
        events = parts[0] if parts else capture.events
        for more in parts[1:]:
            events = events.unionByName(more, allowMissingColumns=True)
        events = D.rebased(events, ranks).withColumn("ts", F.col("rel")).withColumn("te", F.expr("ts + dur")).drop("rel", "offset")
        if sample_budget is not None:
            events = D.stride_sampled(events, sample_budget, 5000).drop("seen", "stride")
            capture.sampled = True
        capture.events = kept(events, "capture-events")
        side = None
        if "json-aux" in has:
            capture.aux = kept(records.read_aux(self.spark, files=of_kind("json-aux")), "capture-aux")
            side = records.side_markers(capture.aux).selectExpr(f"cast(ts - {origin} as bigint) as ts", "cast(dur as bigint) as dur", "text")
        capture.markers = kept(P.phase_markers(capture.events, side), "capture-markers")
        capture.step_source, steps = self._steps(capture)
        capture.steps = kept(steps, "capture-steps")
        self.captures[capture.label] = capture
        return capture

    def lineage(self, capture: Capture) -> DataFrame:
        """(path, length, events): every artifact of a capture beside the number of its events."""
        return records.lineage(capture.artifacts, capture.events)

    def _steps(self, capture: Capture) -> tuple[str, DataFrame]:
        ev, sources = capture.events, []
        table = capture.tables.get("step_trace_time")
        if table is not None:
            part = lambda *cs: "coalesce(" + ", ".join([c for c in cs if c in table.columns] + ["0"]) + ")"
            stated = "coalesce(" + ", ".join([f"case when {c} > 0 then {c} end" for c in ("step_total", "dur_us", "total_us") if c in table.columns] + ["null"]) + ")"
            total = f"coalesce({stated}, {part('step_computing')} + {part('step_comm_not_overlapped', 'step_comm')} + {part('step_free')})"
            stage = "step_stage" if "step_stage" in table.columns else "cast(null as string)"
            rows = table.where("step is not null").selectExpr("cast(step as int) as step", f"cast({total} as bigint) as total_us", f"{stage} as stage")
            sources.append(("table", P.cumulative_steps(rows).join(rows.groupBy("step").agg(F.max("stage").alias("stage")), "step")))
        sources.append(("markers", P.marker_steps(capture.markers, phase=F.col("phase"))))
        sources.append(("engine", P.engine_steps(ev).selectExpr("cast(row_number() over (order by ws) - 1 as int) as step", "ws", "we")))
        pauses = P.gap_segments(ev).selectExpr("segment as step", "ws", "we")
        sources.append(("gaps", pauses.join(F.broadcast(pauses.agg(F.count("*").alias("__n"))).where("__n > 1")).drop("__n")))
        sources.append(("window", P.whole_window(ev)))
        return P.choose_steps(sources)

    def utilisation(self, capture: Capture) -> DataFrame:
        """One row: events that state their work, TFLOP/s that they achieved together, and the share of the peak (null without one)."""
        ev = capture.events
        work = ev.withColumn("flops", F.lit(None).cast("double")) if "flops" not in ev.columns else ev
        work = work.where("flops > 0 and dur > 0")
        rate = D.throughput(work, "flops", "dur", self.peak_tflops or 0.0)
        both = rate.join(F.broadcast(work.agg(F.count("*").alias("events"))))  # one row each
        known = F.col("events") > 0
        return both.select("events", F.when(known, F.col("tflops")).alias("tflops"), F.when(known & F.lit(bool(self.peak_tflops)), F.col("of_peak_pct")).alias("of_peak_pct"))

    def phases(self, capture: Capture) -> DataFrame:
        """Steps with their phase, the method and its confidence."""
        return P.labelled(capture.steps.withColumn("wall_us", F.expr("we - ws")), "wall_us", capture.markers)

    def indicators(self, capture: Capture) -> DataFrame:
        """Indicator rows of the whole capture and of each known phase; computed once for each capture."""
        if capture.block is None:
            capture.block = self._indicators(capture)
        return capture.block

    def _indicators(self, capture: Capture) -> DataFrame:
        labelled = kept(self.phases(capture), "capture-phases")
        known = labelled.groupBy("phase").agg(F.min("ws").alias("ws"), F.max("we").alias("we"), F.count("*").cast("int").alias("steps"), F.sum("wall_us").alias("wall")).where("phase <> 'unknown'").orderBy(F.desc("wall"), "phase").collect()  # two rows at most
        sure = (labelled.agg(F.max("confidence")).first()[0]) or "low"
        whole = D.window_of(capture.events).first()
        begin, end = (whole["ws"], whole["we"]) if whole["ws"] is not None else (0, 0)
        # the whole capture counts as its longest phase, for advice that is for one phase
        scopes = [("overall", known[0]["phase"] if known else "overall", begin, end, capture.steps.count())] + [(r["phase"], r["phase"], r["ws"], r["we"], r["steps"]) for r in known]
        scopes = self.spark.createDataFrame(scopes, "scope string, phase string, ws long, we long, steps int")
        names = [c for c in ("idx", "device", "category", "subtype", "role", "name", "ts", "te", "dur", "size_mb") if c in capture.events.columns]
        values = {}
        tables = [t.select(F.explode("utilization").alias("m", "v"), F.coalesce("dur_us", "total_us", F.lit(1.0)).alias("w")) for t in capture.tables.values()]
        if tables:
            means = reduce(DataFrame.unionByName, tables).groupBy("m").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("v")).collect()
            values = {r["m"]: r["v"] for r in means}  # ten metrics at most
        context = {"mac": F.lit(values.get("mac")).cast("double"), "mte2": F.lit(values.get("mte2")).cast("double"), "phaseMix": F.lit(len(known) > 1), "phaseConfidence": F.lit(sure), "missingTables": F.lit(not capture.tables)}
        return A.settled(A.indicators(capture.events.select(*names), scopes).withColumns(context))

    def scoped(self, capture: Capture, phase: str = "auto") -> DataFrame:
        """Indicator rows to judge: all scopes, or with a ``phase`` named, one scope that is held to be of that phase."""
        block = self.indicators(capture)
        if phase == "auto":
            return block
        own = "scope = '{0}'".format(phase) if block.where(F.col("scope") == phase).count() else "scope = 'overall'"
        return A.settled(block.where(own).withColumn("scope", F.lit(phase)).withColumn("phase", F.lit(phase)))

    def analyze(self, capture: Capture, thresholds: dict | None = None, phase: str = "auto", trigger: float = A.rules.TRIGGER_SCORE) -> dict[str, DataFrame]:
        """Indicators, candidates, verdicts, evidence, causes and what triggered them, advice, gains and warnings.

        ``thresholds`` replaces limits by name, ``phase`` asserts that the whole capture is of one phase.
        """
        for name in thresholds or {}:
            A.S.threshold(name)  # an unknown name is an error
        block = self.scoped(capture, phase)
        advice, causes, reached = A.advice(block, trigger, thresholds), A.causes(block, trigger, thresholds), A.candidates(block, thresholds)
        return {
            "indicators": block, "candidates": reached, "verdicts": A.verdicts(block, trigger, thresholds), "headline": A.headline(block, trigger, thresholds), "evidence": A.evidence(block, thresholds), "missing": A.missing(block, thresholds), "evidence_table": A.evidence_table(block),
            "causes": causes, "triggers": A.triggers(causes, block), "advice": A.merged_advice(advice), "levels": A.by_level(advice), "actions": A.top_actions(advice), "gains": A.combined_gains(advice), "warnings": A.warnings(self.indicators(capture), reached, capture.sampled),
        }

    def _side(self, capture: Capture, phase: str) -> DataFrame:
        """One row of what has to be alike for a comparison."""
        rows = self.indicators(capture).select("scope", "phase", "wallUs", "stepCount").collect()  # three rows at most
        whole = next(r for r in rows if r["scope"] == "overall")
        walls = {r["phase"]: r["wallUs"] for r in rows if r["scope"] != "overall"}
        mix = {k: round(v / max(sum(walls.values()), 1e-9) * 100, 1) for k, v in walls.items()}
        names = [r["name"] for r in capture.artifacts.select("name").distinct().collect()] if capture.artifacts is not None else []  # one row for each file
        best = A.headline(self.scoped(capture, phase)).first()
        row = (whole["stepCount"], float(whole["wallUs"]), mix, phase, capture.sampled, "tables" if capture.sampled and capture.tables else "trace", names, best["bottleneck"] if best else "balanced")
        return self.spark.createDataFrame([row], "steps int, wall_us double, mix map<string,double>, override string, sampled boolean, source string, files array<string>, bottleneck string")

    def compare(self, before: Capture, after: Capture, phase: str | tuple[str, str] = "auto") -> dict[str, DataFrame]:
        """Metrics, categories, operators, what became of the advice of the first capture, whether both can be compared, warnings, headline."""
        said = (phase, phase) if isinstance(phase, str) else phase
        b, a = self.scoped(before, said[0]), self.scoped(after, said[1])
        whole = lambda x: x.where("scope = 'overall'")
        metrics = A.settled(A.compared_metrics(whole(self.indicators(before)), whole(self.indicators(after))))
        side = lambda c: c.events.groupBy(F.col("category").alias("name")).agg(F.sum("dur").alias("total_us"))
        verified = A.settled(A.verified_advice(A.merged_advice(A.advice(b)), metrics, A.merged_advice(A.advice(a))))
        checks = A.settled(A.comparability(self._side(before, said[0]), self._side(after, said[1])))
        return {
            "metrics": metrics, "categories": A.compared_operators(side(before), side(after)), "operators": A.compared_operators(D.operator_stats(before.events), D.operator_stats(after.events)), "advice": verified,
            "comparability": checks, "warnings": A.comparison_warnings(checks, metrics, verified), "headline": A.comparison_headline(metrics, verified, A.headline(b), A.headline(a)),
        }

    def view(self, capture: Capture, budget: int = 150_000) -> DataFrame:
        """What a page shows: each operator with its quota and its longest events in order of time, as JSON rows."""
        stats = D.operator_stats(capture.events)
        quota = V.event_budget(stats, budget, 20)
        kept = V.within_quota(capture.events.select("device", "name", "idx", "ts", "dur"), quota)
        rows = kept.groupBy("device", "name").agg(F.sort_array(F.collect_list(F.struct("ts", "dur", "idx"))).alias("events"))
        return rows.join(stats, ["device", "name"]).select(F.to_json(F.struct("device", "name", "count", "total_us", "events")).alias("json"))

    def page(self, capture: Capture, budget: int = 150_000, operators: int = 400, ranking: int = 60, gaps: int = 30) -> dict[str, DataFrame]:
        """The parts of a page (operators, rankings, categories, overlap, gaps, lanes), and its steps with their phases."""
        parts = V.page(capture.events, D.operator_stats(capture.events), budget, operators, ranking, gaps)
        return parts | {"steps": self.phases(capture)}

    def report(self, capture: Capture, html: bool = False) -> str:
        """Markdown (or printable HTML) report."""
        text = report.markdown(capture.label, self._tables(capture))
        return report.html(text, capture.label) if html else text

    def _tables(self, capture: Capture) -> dict[str, list[dict]]:
        out = {k: [r.asDict() for r in v.collect()] for k, v in self.analyze(capture).items()}  # rows for each scope and rule
        out["operators"] = [r.asDict() for r in D.ranked(D.operator_stats(capture.events), top=self.top_n).orderBy("rank").collect()]
        out["categories"] = [r.asDict() for r in D.category_totals(capture.events).collect()]
        out["steps"] = [{"source": capture.step_source, "steps": capture.steps.count()}]
        out["files"] = [r.asDict() for r in capture.artifacts.select("name", "kind", "length").collect()] if capture.artifacts is not None else []
        return out

    def export(self, capture: Capture, folder: str) -> list[str]:
        """Write report.md, report.html, report.json and a zip of them; returns the paths."""
        self._guard(folder)
        os.makedirs(folder, exist_ok=True)
        tables = self._tables(capture)
        text = report.markdown(capture.label, tables)
        files = {"report.md": text, "report.html": report.html(text, capture.label), "report.json": json.dumps(tables, default=str, indent=1)}
        data = {k: v.encode() for k, v in files.items()}
        data["report.zip"] = records.write_zip(list(data.items()))
        for name, content in data.items():
            with open(os.path.join(folder, name), "wb") as f:
                f.write(content)
        return [os.path.join(folder, k) for k in data]

    def handoff(self, capture: Capture, advice: str, folder: str) -> str:
        """Task package of one advice: target operators, metrics with the gain that counts as reached, as Markdown and JSON."""
        self._guard(folder)
        a = self.analyze(capture)
        row = a["advice"].where(F.col("advice") == advice).first()
        if row is None:
            raise KeyError(advice)
        category = {"comm": "comm", "copy": "copy", "compute": "compute"}.get(advice.split(".")[0])
        stats = D.operator_stats(capture.events).join(D.dominant_category(capture.events).select("device", "name", "category"), ["device", "name"])
        targets = (stats.where(F.col("category") == category) if category else stats.where("device = 'host'")).orderBy(F.desc("total_us"), "name").limit(3).select("name", "total_us")
        whole = self.indicators(capture).where("scope = 'overall'").first()
        accept = max(1.0, int(row["gain_pct"] * 5 + 0.5) / 10)
        goals = [{"metric": m, "now": whole[m], "better": dict(A.rules.METRICS)[m], "improve_by_pct": accept} for m in A.rules.ADVICE_TARGETS.get(advice, [])]
        task = {"capture": capture.label, "advice": advice, "expected_pct": row["gain_pct"], "accept_pct": accept, "metrics": [g["metric"] for g in goals], "acceptance": goals, "operators": [r.asDict() for r in targets.collect()]}
        task["prompt"] = report.prompt(task)
        os.makedirs(folder, exist_ok=True)
        base = os.path.join(folder, advice.replace(".", "-"))
        with open(base + ".json", "w") as f:
            json.dump(task, f, indent=1)
        with open(base + ".md", "w") as f:
            f.write(report.task(task))
        return base + ".md"
