"""Scalar functions as Spark columns: rounding, shares, tolerant numbers, units, names, classes, severities, verdicts.

All stay inside the JVM; none is a Python UDF.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.plans import rules


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def round_half_up(x, digits: int = 2) -> Column:
    """``floor(x * 10^d + 0.5) / 10^d``; 0 for null, NaN and infinities."""
    x, unit = _col(x).cast("double"), float(10**digits)
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.when(finite, F.floor(x * unit + 0.5).cast("double") / unit).otherwise(F.lit(0.0))


def percent_of(part, whole) -> Column:
    """100 * part / whole; 0 if the whole isn't positive."""
    part, whole = _col(part).cast("double"), _col(whole).cast("double")
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def placeholder_to_null(text) -> Column:
    """Trimmed text, null for the spellings of "no value"."""
    text = F.trim(_col(text))
    return F.when(F.lower(text).isin(rules.PLACEHOLDERS), None).otherwise(text)


def number(text) -> Column:
    """Tolerant number: thousands marks, blanks and a percent sign are ignored; null if it still isn't one."""
    return F.regexp_replace(placeholder_to_null(text), "[,_ %]", "").try_cast("double")


def ratio(x) -> Column:
    """Share from a share or a percentage: above 1.5 it is a percentage."""
    x = _col(x)
    return F.when(x > 1.5, x / 100).otherwise(x)


def header_key(text) -> Column:
    """Lower-case letters, digits and marks of a header cell without blanks and underlines."""
    return F.regexp_replace(F.lower(F.trim(_col(text))), r"[\s_]+", "")


def header_unit(text) -> Column:
    """Unit that a header names (us if none)."""
    text = F.lower(_col(text))
    return F.when(text.rlike(r"\(\s*(?:ms|milliseconds?)\s*\)"), "ms").when(text.rlike(r"\(\s*(?:ns|nanoseconds?)\s*\)"), "ns").when(text.rlike(r"\(\s*(?:s|sec|seconds?)\s*\)"), "s").otherwise("us")


def to_us(x, unit) -> Column:
    """Microseconds of a value in a unit."""
    x, unit = _col(x).cast("double"), _col(unit)
    return F.when(unit == "ms", x * 1000.0).when(unit == "s", x * 1000000.0).when(unit == "ns", x / 1000.0).otherwise(x)


def rank_from_name(name) -> Column:
    """Rank that a file name carries, null without."""
    name = _col(name)
    first = F.regexp_extract(name, r"(?i)rank[_-]?(\d+)", 1)
    second = F.regexp_extract(name, r"(?i)(?:device|profiler_info)[_-]?(\d+)", 1)
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(second, F.lit("")))


def normalize_name(name) -> Column:
    """Aggregation key of an operator name."""
    value = F.trim(F.coalesce(_col(name), F.lit("")))
    for part in (f"(?i){rules.NAME_PREFIX}", f"(?i){rules.NAME_HASH}", rules.NAME_INSTANCE):
        value = F.regexp_replace(value, part, "")
    rest = F.regexp_replace(value, f"(?i){rules.NAME_WRAPPER}", "")
    known = reduce(lambda c, r: c.when(rest.rlike("(?i)" + r[0]), r[1]), rules.NAME_COLLECTIVES[1:], F.when(rest.rlike("(?i)" + rules.NAME_COLLECTIVES[0][0]), rules.NAME_COLLECTIVES[0][1]))
    value = F.when(value.rlike(f"(?i){rules.NAME_WRAPPER}"), known.otherwise(rest)).otherwise(value)
    for part in rules.NAME_ENDINGS:
        value = F.regexp_replace(value, part, "")
    return F.when(value == "", rules.UNNAMED).otherwise(value)


def subtype(text, words: list, default: str) -> Column:
    """First subtype of a vocabulary that matches."""
    text = _col(text)
    found = F.when(text.rlike(rules.pattern(words, words[0][0])), words[0][0])
    for name, _, _ in words[1:]:
        found = found.when(text.rlike(rules.pattern(words, name)), name)
    return found.otherwise(default)


def classify(name, device=None, op_type=None, task_type=None, core_type=None, cat=None) -> Column:
    """struct(category, subtype, role) of an operator, by the ordered rules."""
    text = lambda x: F.lit("") if x is None else F.coalesce(_col(x).cast("string"), F.lit(""))
    raw, op, task, core, trace = map(text, (name, op_type, task_type, core_type, cat))
    named = F.concat_ws(" ", raw, op)
    everything = F.concat_ws(" ", raw, op, task, core, trace)
    inferred = F.when(F.concat_ws(" ", task, core, trace).rlike("(?i)" + rules.DEVICE_TASKS), "device").otherwise("host")
    side = inferred if device is None else F.coalesce(_col(device), inferred)

    def kind(category: str, sub, role: str) -> Column:
        return F.struct(F.lit(category).alias("category"), (sub if isinstance(sub, Column) else F.lit(sub)).alias("subtype"), F.lit(role).alias("role"))

    return (
        F.when(F.concat_ws(" ", op, task, trace).rlike("(?i)" + rules.EXPLICIT_COMM), kind("comm", subtype(raw, rules.COMM_WORDS, "generic"), "communication"))
        .when(everything.rlike(rules.pattern(rules.COMM_WORDS)), kind("comm", subtype(everything, rules.COMM_WORDS, "generic"), "communication"))
        .when(named.rlike(rules.pattern(rules.COPY_WORDS)), kind("copy", subtype(named, rules.COPY_WORDS, "other"), "transfer"))
        .when(everything.rlike(rules.pattern(rules.COPY_WORDS)), kind("copy", subtype(everything, rules.COPY_WORDS, "other"), "transfer"))
        .when((side == "device") & F.concat_ws(" ", task, core).rlike("(?i)" + rules.AI_CPU), kind("schedule", "aicpu", "framework"))
        .when(side == "device", kind("compute", subtype(raw, rules.COMPUTE_WORDS, "other"), "npu-kernel"))
        .when(F.concat_ws(" ", raw, op, core, task).rlike(f"(?i)(?:^|[^a-z])(?:{rules.CPU_KERNEL})(?:[^a-z]|$)"), kind("schedule", "cpu-kernel", "cpu-kernel"))
        .otherwise(kind("schedule", subtype(everything, rules.FRAMEWORK_WORDS, "host-other"), "framework"))
    )


def important(name) -> Column:
    """Operators that sampling must keep: communication, copies, markers."""
    name = F.coalesce(_col(name), F.lit(""))
    return (name != "") & (name.rlike(rules.pattern(rules.COMM_WORDS)) | name.rlike(rules.pattern(rules.COPY_WORDS)) | name.rlike("(?i)" + rules.MARKERS))


def subtype_label(category, sub) -> Column:
    """Display label of a subtype; the subtype itself if there is none."""
    pairs = [x for (c, s), label in rules.SUBTYPE_LABELS.items() for x in (F.lit(f"{c}/{s}"), F.lit(label))]
    return F.coalesce(F.create_map(*pairs)[F.concat_ws("/", _col(category), _col(sub))], _col(sub))


def threshold(rule: str, override: dict | None = None) -> tuple[float, str]:
    """(limit, relation) of a rule; ``override`` replaces limits by name. An unknown name is a KeyError."""
    limit, relation = rules.THRESHOLDS[rule]
    return float((override or {}).get(rule, limit)), relation


def passes(value, rule: str, override: dict | None = None) -> Column:
    """Whether a value crosses a threshold; null doesn't."""
    value, (limit, relation) = _col(value), threshold(rule, override)
    test = {">=": value >= limit, ">": value > limit, "<=": value <= limit, "<": value < limit}[relation]
    return F.coalesce(test, F.lit(False))


def severity(value, rule: str, override: dict | None = None) -> Column:
    """0 before the gate, 0.5 at it, 1 from twice the gate on (half of it for upper limits)."""
    x, (gate, relation) = _col(value).cast("double"), threshold(rule, override)
    share = (x - gate) / max(1e-6, gate) if relation[0] == ">" else (gate - x) / max(1e-6, gate / 2)
    return F.when(passes(value, rule, override), 0.5 + 0.5 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), share))).otherwise(F.lit(0.0))


def describe(value, rule: str, digits: int = 1, override: dict | None = None, unit: str = "") -> Column:
    """Text of a value beside its threshold."""
    limit, relation = threshold(rule, override)
    shown = F.coalesce(F.format_string(f"%.{digits}f", _col(value).cast("double")), F.lit("N/A"))
    return F.concat(shown, F.lit(f"{unit} {relation} {limit:g}{unit}: "), F.when(passes(value, rule, override), "yes").otherwise("no"))


def format_us(value) -> Column:
    """Readable time of microseconds: us below a thousand, else ms, else s."""
    v = _col(value).cast("double")
    return F.when(F.abs(v) < 1000, F.format_string("%.1f us", v)).when(F.abs(v) < 1_000_000, F.format_string("%.2f ms", v / 1000)).otherwise(F.format_string("%.2f s", v / 1_000_000))


def format_pct(value, digits: int = 1) -> Column:
    """Percentage with ``digits`` decimals."""
    return F.format_string(f"%.{digits}f%%", _col(value).cast("double"))


def format_count(value) -> Column:
    """Count with K or M from a thousand or a million on."""
    v = _col(value).cast("double")
    return F.when(F.abs(v) < 1000, F.format_string("%.0f", v)).when(F.abs(v) < 1_000_000, F.format_string("%.1fK", v / 1000)).otherwise(F.format_string("%.2fM", v / 1_000_000))


def format_shape(value) -> Column:
    """Shapes as CANN-like tables write them (``1,2;3,4``) as ``[1x2] [3x4]``; empty for none."""
    parts = F.filter(F.split(F.regexp_replace(F.coalesce(_col(value), F.lit("")), '[" \\[\\]]', ""), ";"), lambda x: x != "")
    return F.array_join(F.transform(parts, lambda x: F.concat(F.lit("["), F.replace(x, F.lit(","), F.lit("x")), F.lit("]"))), " ")


def rel_pct(before, after) -> Column:
    """Relative change in percent; null for missing values and from 0 to something."""
    b, a = _col(before).cast("double"), _col(after).cast("double")
    return F.when(b == 0, F.when(a == 0, F.lit(0.0))).otherwise((a - b) / F.abs(b) * 100)


def improvement_pct(delta, direction) -> Column:
    """Change in the better direction."""
    return F.when(_col(direction) == "higher", _col(delta)).otherwise(-_col(delta))


def judged(delta, direction) -> Column:
    """Whether a change is an improvement; null for neutral metrics and missing changes, false within the noise."""
    d, way = _col(delta), _col(direction)
    return F.when(way.isin("lower", "higher") & d.isNotNull(), F.when(F.abs(d) < rules.NOISE_PCT, F.lit(False)).when(way == "lower", d < 0).otherwise(d > 0))


def acceptance_threshold(expected) -> Column:
    """Least observed gain that counts as reached: half of what was expected, 1 at least."""
    return round_half_up(F.greatest(F.lit(1.0), _col(expected).cast("double") * 0.5), 1)


def stage_phase(stage) -> Column:
    """Phase that a stage text names."""
    s = F.lower(F.coalesce(_col(stage), F.lit("")))
    return F.when(s.rlike(rules.PREFILL_TEXT), "prefill").when(s.rlike(rules.DECODE_TEXT), "decode").otherwise("unknown")


def named_phase(text) -> Column:
    """Phase that a text names, null if none."""
    found = stage_phase(text)
    return F.when(found != "unknown", found)


def format_bytes(n) -> Column:
    """Readable size."""
    n = _col(n).cast("double")
    return (
        F.when(n < 1024, F.format_string("%.0f B", n)).when(n < 1024**2, F.format_string("%.1f KiB", n / 1024)).when(n < 1024**3, F.format_string("%.1f MiB", n / 1024**2)).otherwise(F.format_string("%.2f GiB", n / 1024**3))
    )


def table_kind(name) -> Column:
    """Table kind that a file name tells."""
    name = _col(name)
    found = F.when(name.rlike("(?i)" + rules.TABLE_KINDS[0][1]), rules.TABLE_KINDS[0][0])
    for kind, words in rules.TABLE_KINDS[1:]:
        found = found.when(name.rlike("(?i)" + words), kind)
    return found.otherwise("generic")


def side_of_label(label) -> Column:
    """Side that a process label tells, null if neither."""
    label = _col(label)
    return F.when(label.rlike("(?i)" + rules.DEVICE_LABELS), "device").when(label.rlike("(?i)" + rules.HOST_LABELS), "host")
