"""Personal data: candidate spans, boosted trees, calibrated thresholds. DataFrame and SQL expressions only.

Strict patterns (with Luhn and range tests) give base spans, which always count. High-recall generators propose further,
overlapping spans: spelled-out addresses, numbers without a plus sign, colon addresses, cards in odd groupings. Each proposal gets
format features (digits, groups, checksum) and context features (cue words before it, what stands around it); gradient-boosted
trees score it, a logistic calibration turns the score into a probability, and a threshold per kind selects.

The trees are fitted here, on a seeded generator of texts with known spans and look-alikes (order numbers, dates, versions), of
fixed size and without any row of the input. They become one SQL expression; scanning is a projection without a shuffle.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import common
from .spans import between, found, joined, literal, placed

#: Kinds in order; base patterns (equivalent to the plain ones, written so that no text makes them slow).
KINDS = ["email", "ip", "card", "phone"]
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A condition without which no match of the kind can occur, and the test that a match has to pass.
NEEDS = {"email": "contains({t}, '@')", "ip": "contains({t}, '.')", "card": None, "phone": "contains({t}, '+')"}
PASSES = {
    "email": "true",
    "ip": "x.m rlike '^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:[.]0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$'",
    "card": "length(regexp_replace(x.m, '[^0-9]', '')) between 12 and 19 and luhn_check(regexp_replace(x.m, '[^0-9]', ''))",
    "phone": "length(regexp_replace(x.m, '[^0-9]', '')) between 9 and 15",
}
#: Generators of further candidates, by kind.
GENERATORS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\(dot\)|\[dot\]|\x20dot\x20|\.)\x20?[A-Za-z0-9-]{1,63}+){1,4}+",
    "ip": r"(?<![0-9A-Za-z:_])(?:(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![0-9A-Za-z:_])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{4}(?:[\x20./-]{1,2}[0-9]{4}){2,3}(?:[\x20./-]{1,2}[0-9]{1,4})?|[0-9]{4}[\x20./-]{1,2}[0-9]{6}[\x20./-]{1,2}[0-9]{5})(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+])(?<![0-9][./-])(?<!\+[0-9]{1,3}[\x20().-]{1,2})\(?[0-9]{2,4}\)?[\x20./-]{1,2}[0-9]{3,4}[\x20./-][0-9]{3,4}(?![0-9A-Za-z]|[./-][0-9])",
}
GENERATOR_NEEDS = {"email": "{t} rlike '(?:\\\\(at\\\\)|\\\\[at\\\\]|\\\\x20at\\\\x20)'", "ip": "contains({t}, ':')", "card": "{t} rlike '[0-9]{4}'", "phone": "{t} rlike '[0-9]{3}'"}
CONTEXT = 32
CUES = "(?i)(?:mail|e-mail|contact|write|reach)|(?:ip|addr|host|server|peer)|(?:card|visa|master|amex|credit|payment)|(?:phone|tel|call|fax|mobile|cell|dial|whatsapp)"
LOOKALIKES = "(?i)(?:order|invoice|version|release|ref|isbn|serial|ticket|page|lot|sku|case|date|mac|hash|range)"

#: Features of a candidate x (m: text, b and f: context, k: kind) in SQL.
FEATURES = {
    "kind": "x.k",
    "digits": "length(regexp_replace(x.m, '[^0-9]', ''))",
    "length": "length(x.m)",
    "marks": "length(regexp_replace(x.m, '[^\\\\x20()./-]', ''))",
    "luhn": "cast(coalesce(luhn_check(nullif(regexp_replace(x.m, '[^0-9]', ''), '')), false) as int)",
    "cue": f"cast(x.b rlike {literal(CUES)} as int)",
    "lookalike": f"cast(x.b rlike {literal(LOOKALIKES)} as int)",
    "brackets": "cast(x.m rlike '[(\\\\[]' as int)",
    "colons": "length(regexp_replace(x.m, '[^:]', ''))",
    "numbers_near": "cast(concat(x.b, x.f) rlike '[0-9]' as int)",
    "gap": "cast(contains(x.m, '::') as int)",
}
TREES, RATE, SAMPLES, SEED = 40, 0.3, 3000, 11
#: Precision that each kind's threshold has to reach on candidates that neither trees nor calibration saw.
PRECISION = 0.98


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return bool(digits) and total % 10 == 0


def training_set(n: int = SAMPLES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(features, label) of ``n`` seeded candidates: personal data in its formats, and look-alikes in theirs."""
    import re

    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    rows, labels = [], []
    for _ in range(n):
        kind, real = int(rng.integers(4)), bool(rng.random() < 0.5)
        b, f = "the words before it are ", " and so on"
        if kind == 0:
            m = pick(["ann", "j.doe", "sales"]) + (pick([" (at) ", "(at)", " [at] ", "[at]"]) if real else " at ") + pick(["mail", "corp-x", "site"]) + (pick([" (dot) ", "[dot]", " dot ", "."]) if real else pick([".", " dot "])) + pick(["org", "net", "noon"])
            b = pick(["contact me: ", "write to ", "my mail is ", b]) if real else pick(["we met ", "he was ", b])
        elif kind == 1:
            hexes = lambda n, low, high: ":".join("".join(pick("0123456789abcdef") for _ in range(int(rng.integers(low, high)))) for _ in range(n))
            if rng.random() < 0.5:
                m = hexes(int(rng.integers(6, 9)), 2, 5) if real else hexes(int(rng.integers(4, 7)), 2, 3)
            else:
                m = pick(["2001:", "fe80:", "2a00:", "fd12:"]) + hexes(int(rng.integers(1, 4)), 3, 5) + "::" + hexes(int(rng.integers(1, 4)), 1, 5) if real else pick([hexes(1, 1, 4) + "::" + hexes(1, 1, 4), "::" + hexes(1, 1, 5), hexes(1, 1, 3) + "::"])
                m = pick(["2001:db8::", "fe80::"]) + hexes(1, 1, 5) if real and rng.random() < 0.3 else m
            b = pick(["server addr ", "peer ", "host ip ", b]) if real else pick(["mac ", "hash ", "at time ", b, "call "])
        elif kind == 2:
            cut = pick([(0, 4, 8, 12, 16), (0, 4, 10, 15)])
            while True:
                raw = digits(cut[-1])
                if _luhn(raw) == (real and rng.random() < 0.95):
                    break
            m = pick([".", "/", " - ", "- "]).join(raw[i:j] for i, j in zip(cut, cut[1:], strict=False))
            b = pick(["card ", "visa: ", "credit card no ", b]) if real else pick(["order ", "serial ", "ref ", b])
        else:
            a, c, d = digits(3), digits(3), digits(4)
            m = pick([f"({a}) {c}-{d}", f"{a}-{c}-{d}", f"{a}.{c}.{d}"]) if real else pick([f"{digits(4)}-{digits(3)}-{digits(3)}", f"{a}/{c}/{d}", f"{a} {c} {c}", f"{a}-{c}-{d}"])
            b = pick(["phone ", "call me at ", "tel. ", "mobile: "] + ([b] if "(" in m else [])) if real else pick(["order ", "invoice ", "version ", "isbn ", b])
        if rng.random() < 0.15:
            f = pick([" 12", "-77 x", " 2024"])
        own = re.sub("[^0-9]", "", m)
        rows.append([kind, len(own), len(m), len(re.sub(r"[^ ()./-]", "", m)), _luhn(own), bool(re.search(CUES, b[-CONTEXT:])), bool(re.search(LOOKALIKES, b[-CONTEXT:])), bool(re.search(r"[(\[]", m)), m.count(":"), bool(re.search("[0-9]", b[-CONTEXT:] + f[:CONTEXT])), "::" in m])
        labels.append(real)
    return np.array(rows, float), np.array(labels, float)


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray, least: int = 20):
    """Best (feature, limit, gain): rows with feature <= limit go left."""
    best = (None, 0.0, 1e-6)
    whole = g.sum() ** 2 / (h.sum() + 1)
    for k in range(x.shape[1]):
        for limit in np.unique(x[:, k])[:-1]:
            left = x[:, k] <= limit
            if least <= left.sum() <= len(x) - least:
                gain = g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1) - whole
                if gain > best[2]:
                    best = (k, float(limit), gain)
    return best


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    k, limit, _ = _split(x, g, h) if depth else (None, 0, 0)
    if k is None:
        return round(float(RATE * g.sum() / (h.sum() + 1)), 6)
    left = x[:, k] <= limit
    return (k, limit, _tree(x[left], g[left], h[left], depth - 1), _tree(x[~left], g[~left], h[~left], depth - 1))


def apply_tree(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    left = x[:, tree[0]] <= tree[1]
    return np.where(left, apply_tree(tree[2], x), apply_tree(tree[3], x))


@lru_cache
def model():
    """(trees, slope, shift, threshold of each kind).

    Boosted trees on half of a training set, a logistic calibration on its other half, and thresholds on a set of their own: the
    lowest probability from which candidates of a kind are right with at least ``PRECISION``; 2, which selects none, if there is none.
    """
    x, y = training_set()
    half = len(x) // 2
    z, trees = np.zeros(half), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        trees.append(_tree(x[:half], y[:half] - p, p * (1 - p), 3))
        z = z + apply_tree(trees[-1], x[:half])
    held = sum(apply_tree(t, x[half:]) for t in trees)
    a, b = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-(a * held + b)))
        e = y[half:] - p
        w = p * (1 - p) + 1e-9
        hess = np.array([[(w * held * held).sum() + 1e-3, (w * held).sum()], [(w * held).sum(), w.sum() + 1e-3]])
        move = np.linalg.solve(hess, [(e * held).sum(), e.sum()])
        a, b = a + 0.5 * move[0], b + 0.5 * move[1]
    a, b = round(float(a), 6), round(float(b), 6)
    x, y = training_set(seed=SEED + 1)
    p = 1 / (1 + np.exp(-(a * sum(apply_tree(t, x) for t in trees) + b)))
    limits = []
    for k in range(len(KINDS)):
        own, right = p[x[:, 0] == k], y[x[:, 0] == k]
        cuts = [c for c in np.unique(own) if right[own >= c].mean() >= PRECISION]
        limits.append(max(0.5, float(min(cuts)) - 1e-9) if cuts else 2.0)
    return trees, a, b, dict(zip(KINDS, limits, strict=True))


def _sql_tree(tree) -> str:
    if not isinstance(tree, tuple):
        return f"{tree}D"
    return f"case when y.f{tree[0]} <= {tree[1]:g} then {_sql_tree(tree[2])} else {_sql_tree(tree[3])} end"


def probability() -> str:
    """SQL: probability of a candidate ``y`` with features f0, f1, ..."""
    trees, a, b, _ = model()
    return f"1 / (1 + exp(-({a}D * ({' + '.join(map(_sql_tree, trees))}) + {b}D)))"


def detected(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", text_out: bool = False) -> DataFrame:
    """``keep``, ``__base`` and ``__spans`` of every row: arrays of (s, k, e), k the number of the kind in KINDS.

    A null text is empty. Texts of any length are scanned whole; places are code points, ends exclusive. ``__spans`` holds the
    base spans and the selected candidates, each once, in order. ``text_out`` keeps the text as ``__t`` too.
    """
    names = [f"`{k}`" for k in keep]
    src = docs.selectExpr(*names, f"coalesce(`{text_col}`, '') as __t")
    patterns = [(f"b_{k}", BASE[k], (NEEDS[k] or "{t} rlike '[0-9][\\\\x20-]?[0-9]'").format(t="__t")) for k in KINDS]
    patterns += [(f"g_{k}", GENERATORS[k], GENERATOR_NEEDS[k].replace("{t}", "__t")) for k in KINDS]
    step = src.selectExpr("*", *(f"{found('__t', p, need)} as __m_{k}" for k, p, need in patterns))
    step = step.selectExpr("*", *(f"{between('__t', p, f'__m_{k}')} as __p_{k}" for k, p, _ in patterns))
    tail = ["__t"] if text_out else []
    step = step.selectExpr(*names, *tail, *(f"{placed(f'__m_{k}', f'__p_{k}', k, CONTEXT if k[0] == 'g' else 0)} as __a_{k}" for k, _, _ in patterns))
    base = ", ".join(f"transform(filter(__a_b_{k}, x -> {PASSES[k]}), x -> named_struct('s', x.s, 'k', {n}, 'e', x.e))" for n, k in enumerate(KINDS))
    more = ", ".join(f"transform(__a_g_{k}, x -> named_struct('s', x.s, 'k', {n}, 'e', x.e, 'm', x.m, 'b', x.b, 'f', x.f))" for n, k in enumerate(KINDS))
    step = step.selectExpr(*names, *tail, f"array_sort(concat({base})) as __base", f"concat({more}) as __c")
    traits = ", ".join(f"'f{i}', {v}" for i, v in enumerate(FEATURES.values()))
    step = step.selectExpr(*names, *tail, "__base", f"transform(__c, x -> named_struct('s', x.s, 'k', x.k, 'e', x.e, {traits})) as __c")
    limits = "get(array(" + ", ".join(f"{v!r}D" for v in model()[3].values()) + "), y.k)"
    step = step.selectExpr(*names, *tail, "__base", f"transform(filter(__c, y -> {probability()} >= {limits}), y -> named_struct('s', y.s, 'k', y.k, 'e', y.e)) as __c")
    step = step.selectExpr(*names, *tail, "__base", "array_sort(concat(__base, __c)) as __all")
    return step.selectExpr(*names, *tail, "__base", "filter(__all, (x, i) -> i = 0 or get(__all, i - 1) <> x) as __spans")


def redacted(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, e.g. ``[EMAIL]``; overlapping spans become one, of the first's kind.

    Columns stay as they are; ``length_col``, if there is such a column, gets the new length. Null texts stay null.
    """
    got = detected(docs, tuple(docs.columns), text_col, text_out=True)
    kind = "get(array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + "), x.k)"
    piece = "substring(__t, cast(a.pos + 1 as int), cast(x.s - a.pos as int))"
    merge = f"case when x.e <= a.pos then a when x.s < a.pos then named_struct('pos', x.e, 'out', a.out) else named_struct('pos', x.e, 'out', concat(a.out, array({piece}, {kind}))) end"
    new = f"aggregate(__spans, named_struct('pos', 0L, 'out', cast(array() as array<string>)), (a, x) -> {merge}, a -> concat(array_join(a.out, ''), substring(__t, cast(a.pos + 1 as int))))"
    got = got.withColumn("__new", _when(new, text_col))
    out = []
    for c in docs.columns:
        if c == text_col:
            out.append(f"__new as `{c}`")
        elif c == length_col:
            out.append(f"cast(coalesce(length(__new), `{c}`) as {docs.schema[c].dataType.simpleString()}) as `{c}`")
        else:
            out.append(f"`{c}`")
    return got.selectExpr(*out)


def _when(new: str, text_col: str):
    from pyspark.sql import functions as F

    return F.expr(f"case when `{text_col}` is null then null when size(__spans) = 0 then `{text_col}` else {new} end")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: counts, digest of the base spans and all spans of every document."""
    got = detected(common.table(spark, sf_dir, "documents"))
    counts = [f"cast(size(filter(__base, x -> x.k = {n})) as bigint) as n_{k}" for n, k in enumerate(KINDS)]
    return got.selectExpr("doc_id", *counts, f"sha2({joined('__base', KINDS)}, 256) as base_sha256", f"{joined('__spans', KINDS)} as spans")
