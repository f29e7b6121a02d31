"""Secret scan with multipart credential linking. DataFrame and SQL expressions only.

Strong patterns (assignments, access identifiers, long hex) are reported wherever they stand. Weak candidates are too common
to report alone: user or client identifiers, bare 40-character keys and endpoints. An interval join links the parts of a
credential within a scope (a paragraph): an identifier, a secret and an endpoint with at most ``REACH`` characters between the end of
one and the start of the next. Parts that overlap are one thing seen twice and don't link. A weak candidate is reported only if a
complementary part stands that near: an identifier needs a secret, an endpoint a secret that is named as one (or a bare key or hex run with an
identifier near the endpoint too), a bare key an identifier; so a link beside a hash is none.

The join is an ordered pass over the starts and ends of the parts of each row, and one back: the last end before a start, the first start
behind an end, for each role. It never builds pairs, and scopes are numbered by one pass as well. Only the parts are shuffled, by row,
never the texts; a row's parts are bounded by its own text. Linked parts carry the number of their credential.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .spans import between, found, joined, placed

#: Characters between two parts of one credential, at most.
REACH = 400
SCOPE_WIDTH = 1 << 40

#: Kinds in order, with their role, pattern and the condition on a match (``x``: the match).
BASE = [
    ("assign", "secret", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", None),
    ("access", "identifier", r"AKIA[A-Z0-9]+", "length(x) >= 16"),
    ("hex", "bare", r"(?<![0-9a-f])[0-9a-f]{32,}+", None),
]
WEAK = [
    ("ident", "identifier", r"""(?i)(?<![a-z0-9_])(?:user(?:name)?|login|client_?id|account|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}+"""),
    ("key40", "bare", r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"),
    ("endpoint", "endpoint", r"(?i)(?:(?:https?|ftp|ssh|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3)://[A-Za-z0-9._~:/?#@%&=+-]{4,}+|(?<![a-z0-9_])(?:host|server|endpoint)\x20*[:=]\x20*[A-Za-z0-9.-]{4,}+)"),
]
KINDS = [k[0] for k in BASE] + [k[0] for k in WEAK]
#: A bare secret isn't named as one.
ROLES = {"identifier": 0, "secret": 1, "endpoint": 2, "bare": 3}
_ROLE_OF = [ROLES[k[1]] for k in BASE] + [ROLES[k[1]] for k in WEAK]
#: For each role the SQL of a complementary part near, over ``__has0`` to ``__has3``.
COMPLEMENT = ["__has1 or __has3", "__has0 or __has2", "__has1 or __has3 and __has0", "__has0"]

_LEAD = r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?"""


def _condition(kind: str) -> str:
    if kind == "assign":
        return f"length(regexp_replace(x.m, {_sql(_LEAD)}, '')) >= 8"
    if kind == "access":
        return "length(x.m) >= 16"
    return "true"


def _sql(pattern: str) -> str:
    from .spans import literal

    return literal(pattern)


def scanned(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``keep`` and ``parts``: array of (s, k, e, scope) of all candidates of every row, strong and weak, by place."""
    src = docs.select(*keep, docs[text_col].alias("__t")).selectExpr(*(f"`{k}`" for k in keep), "coalesce(__t, '') as __t")
    patterns = [(k[0], k[2]) for k in BASE] + [(k[0], k[2]) for k in WEAK]
    needs = {"access": "contains(__t, 'AKIA')", "ident": "(contains(__t, '=') or contains(__t, ':'))", "endpoint": "(contains(__t, '=') or contains(__t, ':'))", "assign": "(contains(__t, '=') or contains(__t, ':'))"}
    step = src.selectExpr("*", *(f"{found('__t', p, needs.get(k))} as __m_{k}" for k, p in patterns), f"{found('__t', _SCOPES, None)} as __m_scope")
    step = step.selectExpr("*", *(f"{between('__t', p, f'__m_{k}')} as __p_{k}" for k, p in patterns), f"{between('__t', _SCOPES, '__m_scope')} as __p_scope").drop("__t")
    step = step.selectExpr(*(f"`{k}`" for k in keep), *(f"filter({placed(f'__m_{k}', f'__p_{k}', k)}, x -> {_condition(k)}) as __s_{k}" for k, _ in patterns), f"transform({placed('__m_scope', '__p_scope', 'scope')}, x -> x.s) as __scopes")
    arrays = ", ".join(f"transform(__s_{k}, x -> named_struct('s', x.s, 'k', {n}, 'e', x.e))" for n, (k, _) in enumerate(patterns))
    return step.selectExpr(*(f"`{k}`" for k in keep), f"concat({arrays}) as parts", "__scopes as scopes")


#: A scope ends at an empty line.
_SCOPES = r"\n[\x20\t]*\n"


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans, links) of every row: strong spans, and strong spans with the linked weak ones, as arrays of (s, k, e).

    ``links`` tells which spans form one credential: arrays of (c, s, k, e) of all spans with a complementary part near, ``c`` counting
    the credentials of the row from 1; parts of one scope belong together as long as each follows the one before within ``REACH``.

    A null text is empty. Every row gets its own result row, repeated rows and null ids too. Places are code points, ends exclusive.
    """
    keyed = docs.selectExpr("monotonically_increasing_id() as __row", f"`{id_col}` as __id", f"`{text_col}` as __text")
    parts = scanned(keyed, ("__row", "__id"), "__text")
    # scope ends go along as parts of no kind, and one empty part keeps every row
    ends = "transform(scopes, x -> named_struct('s', x, 'k', -1, 'e', x))"
    rows = parts.selectExpr("__row", "__id", f"explode(concat(parts, {ends}, array(cast(null as struct<s:bigint,k:int,e:bigint>)))) as part")
    rows = rows.selectExpr("*", f"part.s + {SCOPE_WIDTH} * count_if(part.k = -1) over (partition by __row order by part.s, part.k desc rows unbounded preceding) as __at").where("part is null or part.k >= 0")
    rows = rows.selectExpr("*", "__at + part.e - part.s as __to", f"get(array({', '.join(map(str, _ROLE_OF))}), part.k) as __role")
    # starts and ends in order; at one place ends come first, so parts that touch are disjoint
    points = rows.selectExpr("*", "inline(array(named_struct('__pos', __to, '__start', 0), named_struct('__pos', __at, '__start', 1)))")
    doc, ahead, back = "partition by __row order by __at", "partition by __row order by __pos, __start rows unbounded preceding", "partition by __row order by __pos desc, __start desc rows unbounded preceding"
    n = len(ROLES)
    near = points.selectExpr("*", *(f"case when __start = 1 then max(case when __start = 0 and __role = {r} then __pos end) over ({ahead}) end as __end{r}" for r in range(n)), *(f"case when __start = 0 then min(case when __start = 1 and __role = {r} then __pos end) over ({back}) end as __start{r}" for r in range(n)))
    both = near.groupBy("__row", "__id", "part", "__at", "__to", "__role").agg(*(F.max(f"__end{r}").alias(f"__end{r}") for r in range(n)), *(F.min(f"__start{r}").alias(f"__start{r}") for r in range(n)))
    seen = both.selectExpr("*", *(f"(coalesce(__at - __end{r} <= {REACH}, false) or coalesce(__start{r} - __to <= {REACH}, false)) as __has{r}" for r in range(n)))
    others = "case __role " + " ".join(f"when {r} then {c}" for r, c in enumerate(COMPLEMENT)) + " end"
    told = seen.selectExpr("__row", "__id", "__at", "__to", "part", f"case when part.k < {len(BASE)} then part end as __base", f"case when part.k < {len(BASE)} or {others} then part end as __told", f"coalesce({others}, false) as __link")
    told = told.selectExpr("*", f"max(case when __link then __to end) over ({doc}, part.k rows between unbounded preceding and 1 preceding) as __last")
    told = told.selectExpr("*", f"count_if(__link and (__last is null or __at - __last > {REACH})) over ({doc}, part.k rows between unbounded preceding and current row) as __c")
    told = told.selectExpr("__row", "__id", "__base", "__told", "case when __link then named_struct('c', __c, 's', part.s, 'k', part.k, 'e', part.e) end as __linked")
    out = told.groupBy("__row").agg(F.first("__id").alias("__id"), *(F.collect_list(f"__{c}").alias(n) for c, n in (("base", "base"), ("told", "spans"), ("linked", "links"))))
    return out.selectExpr(f"__id as `{id_col}`", "base", "spans", "array_sort(links) as links")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: counts, digest of the base spans and all spans of every document."""
    got = linked(common.table(spark, sf_dir, "documents"))
    counts = [f"cast(size(filter(base, x -> x.k = {n})) as bigint) as n_{k[0]}" for n, k in enumerate(BASE)]
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    links = f"array_join(transform(links, x -> concat(x.c, '=', get({names}, x.k), ':', x.s, ':', x.e)), ',') as links"
    return got.selectExpr("doc_id", *counts, f"sha2({joined('base', KINDS)}, 256) as base_sha256", f"{joined('spans', KINDS)} as spans", links)
