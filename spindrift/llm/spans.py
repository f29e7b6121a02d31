"""Spans of pattern matches as SQL expressions: no Python touches a row.

Spark's pattern functions give matches but not their places. A text split at a pattern gives the pieces between the matches, and
both follow the same leftmost, non-overlapping search; so running sums of the lengths of pieces and matches are the places, in
code points. The sums run over chunks of matches, so that a text with very many matches costs linear time, not quadratic.
"""

from __future__ import annotations

CHUNK = 256


def literal(pattern: str) -> str:
    """SQL string literal of a Java pattern."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def found(text: str, pattern: str, needs: str | None = None) -> str:
    """SQL: array of the matches of ``pattern`` in ``text``, null if it has none; ``needs`` is a cheap condition without which none can match."""
    test = f"{text} rlike {literal(pattern)}" if needs is None else f"{needs} and {text} rlike {literal(pattern)}"
    return f"case when {test} then regexp_extract_all({text}, {literal(pattern)}, 0) end"


def between(text: str, pattern: str, matches: str) -> str:
    """SQL: array of the pieces of ``text`` around the matches (one more than matches), null where ``matches`` is."""
    return f"case when {matches} is not null then split({text}, {literal(pattern)}, -1) end"


def placed(matches: str, pieces: str, tag: str, context: int = 0) -> str:
    """SQL: array of (s, e, m): start, end (exclusive) and text of each match; with ``context`` also that many characters before and after.

    ``tag`` keeps the names of lambda variables apart.
    """
    o, c, a, i, z = (f"{x}_{tag}" for x in ("o", "c", "a", "i", "z"))
    extra = ""
    kind = "s: bigint, e: bigint, m: string"
    if context:
        extra = f", 'b', right(get({pieces}, {i}), {context}), 'f', left(get({pieces}, {i} + 1), {context})"
        kind += ", b: string, f: string"
    kind = f"array<struct<{kind}>>"
    begin = f"{a}.pos + length(get({pieces}, {i}))"
    one = f"named_struct('s', {begin}, 'e', {begin} + length(get({matches}, {i})), 'm', get({matches}, {i}){extra})"
    step = f"named_struct('pos', {begin} + length(get({matches}, {i})), 'out', concat({a}.out, array({one})))"
    inner = (
        f"aggregate(sequence({c} * {CHUNK}, least({c} * {CHUNK} + {CHUNK}, size({matches})) - 1), named_struct('pos', {o}.pos, 'out', cast(array() as {kind})), "
        f"({a}, {i}) -> {step}, {z} -> named_struct('pos', {z}.pos, 'outs', concat({o}.outs, array({z}.out))))"
    )
    whole = f"aggregate(sequence(0, cast((size({matches}) - 1) div {CHUNK} as int)), named_struct('pos', 0L, 'outs', cast(array() as array<{kind}>)), ({o}, {c}) -> {inner}, w_{tag} -> flatten(w_{tag}.outs))"
    return f"case when size({matches}) > 0 then {whole} else cast(array() as {kind}) end"


def joined(spans: str, kinds: list[str]) -> str:
    """SQL: ``kind:start:end`` of an array of (s, k, e), by start then kind, comma-joined; k is the kind's number."""
    names = "array(" + ", ".join(f"'{k}'" for k in kinds) + ")"
    return f"array_join(transform(array_sort({spans}), x -> concat(get({names}, x.k), ':', x.s, ':', x.e)), ',')"
