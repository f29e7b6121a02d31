"""Reports from a few small tables."""

from __future__ import annotations

import html as _html

SECTIONS = [
    ("files", "Files"), ("warnings", "Warnings"), ("headline", "Bottleneck"), ("verdicts", "Verdict by scope"), ("candidates", "Scores"), ("evidence_table", "Measures"), ("evidence", "Evidence"), ("missing", "Gates not reached"), ("causes", "Root causes"), ("triggers", "What triggered them"), ("actions", "First actions"), ("advice", "Advice"), ("gains", "Expected gains"), ("operators", "Operators"),
    ("categories", "Categories"), ("steps", "Steps"), ("indicators", "Indicators"),
]


def cell(value) -> str:
    """Text of a table cell."""
    text = "" if value is None else f"{value:g}" if isinstance(value, float) else ", ".join(map(str, value)) if isinstance(value, list) else str(value)
    return text.replace("|", "\\|").replace("\n", " ")


def grid(rows: list[dict]) -> str:
    if not rows:
        return "None.\n"
    names = list(rows[0])
    lines = ["| " + " | ".join(names) + " |", "|" + " --- |" * len(names)]
    return "\n".join(lines + ["| " + " | ".join(cell(r[k]) for k in names) + " |" for r in rows]) + "\n"


def markdown(label: str, tables: dict[str, list[dict]]) -> str:
    """One section for each table."""
    out = [f"# Profile of {label}\n"]
    for key, title in SECTIONS:
        rows = tables.get(key, [])
        if key == "indicators" and rows:
            rows = [{"measure": k} | {r["scope"]: r[k] for r in rows} for k in rows[0] if k not in ("scope", "phase")]
        out.append(f"## {title}\n\n{grid(rows)}")
    out.append("## Caveats\n\nGains overlap and don't add up; shares of sums can exceed 100 % where operators run side by side.\n")
    return "\n".join(out)


def html(text: str, title: str) -> str:
    """Printable page of a Markdown report made here."""
    body, table = [], False
    for line in text.split("\n"):
        if line.startswith("|") and not line.startswith("| ---") and set(line) - set("|- "):
            if not table:
                body.append("<table>")
            cells = [_html.escape(c.strip().replace("\\|", "|")) for c in line.strip("|").split(" | ")]
            body.append("<tr>" + "".join(f"<{'td' if table else 'th'}>{c}</{'td' if table else 'th'}>" for c in cells) + "</tr>")
            table = True
            continue
        if table and not line.startswith("|"):
            body.append("</table>")
            table = False
        if line.startswith("#"):
            n = len(line) - len(line.lstrip("#"))
            body.append(f"<h{n}>{_html.escape(line[n:].strip())}</h{n}>")
        elif line.strip() and not line.startswith("|"):
            body.append(f"<p>{_html.escape(line)}</p>")
    return f"<!doctype html><meta charset=utf-8><title>{_html.escape(title)}</title><style>@media print{{body{{font:10pt sans-serif}}}}td,th{{border:1px solid #999;padding:2px 6px}}table{{border-collapse:collapse}}</style>{''.join(body)}"


def task(t: dict) -> str:
    """Task of one advice in Markdown."""
    lines = [f"# {t['advice']} for {t['capture']}", "", f"Expected gain: {t['expected_pct']} %; counts as reached from {t['accept_pct']} %.", "", "Metrics: " + (", ".join(t["metrics"]) or "none"), "", "## Acceptance", "", grid(t.get("acceptance", [])), "## Operators", "", grid(t["operators"]), "## Prompt", "", t.get("prompt", "")]
    return "\n".join(lines)


def prompt(t: dict) -> str:
    """The task as a request in words, from its own figures only."""
    goals = "; ".join(f"{g['metric']} is {cell(g['now'])} and should get {g['better']} by at least {g['improve_by_pct']:g} %" for g in t["acceptance"]) or "no metric to compare; improve the capture"
    names = ", ".join(f"{o['name']} ({o['total_us']} us)" for o in t["operators"]) or "none"
    return f"Carry out the advice {t['advice']} for the capture {t['capture']}. Goals: {goals}. Operators to look at first: {names}. Capture again with the same workload, compare, and report each goal as reached or not."
