"""Reports and files for people, from small collected views.

What is rendered has been aggregated and redacted in Spark before; the driver only
formats it, page by page. A healing report and a scaffold have a line for each broken
selector and each field of a job; they are files for people to edit.
"""

from __future__ import annotations

import html
import json
from itertools import chain
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.redaction import redact, redact_frame
from ..functions.safety import FIELD_ROLES, field_kind, is_destructive
from ..functions.text import action_label, markdown_cell, mermaid_text, short_id

#: States of one index page and its diagram; a larger map has more of them.
PAGE_STATES = 2_000


def healing_report(events: DataFrame) -> str | None:
    """Markdown: confident repairs with their new selector, then those to review; None without any."""
    cells = [markdown_cell(F.col(c)).alias(c) for c in ("domain", "field", "new_locator")]
    rows = events.select(*cells, "used", "score").groupBy("domain", "field", "new_locator", "used").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("score"))
    found = rows.orderBy(F.col("used").desc(), "domain", "field", "new_locator").collect()
    if not found:
        return None
    total = {u: sum(r["n"] for r in found if r["used"] == u) for u in (True, False)}
    lines = ["# Healing report", "", f"{total[True] + total[False]} selectors re-resolved: {total[True]} confidently, {total[False]} to review."]
    for used, title in ((True, "Confident"), (False, "Uncertain")):
        part = [r for r in found if r["used"] == used]
        if part:
            lines += ["", f"## {title}", "", "| site | field | suggested selector | best score | times |", "| --- | --- | --- | --- | --- |"]
            lines += [f"| {r['domain']} | {r['field']} | {r['new_locator']} | {r['score']:.3f} | {r['n']} |" for r in part]
    return "\n".join(lines) + "\n"


def run_summary(counts: dict, challenge: tuple[str, str] | None = None) -> str:
    """A run's counts as text; lines of zero counts that are only notes are left out."""
    lines = ["Run summary:"] + [f"  {k}: {counts.get(k, 0)}" for k in ("records", "pages", "blocked")]
    lines += [f"  {k}: {counts[k]}" for k in ("deads", "unchangeds", "retrys", "healed", "uncertain") if counts.get(k)]
    if challenge:
        lines.append(f"  challenge: {challenge[0]} (not scraped as data)")
    return "\n".join(lines) + "\n"


def _page(title: str, body: str) -> str:
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{body}</body></html>"


def _listed(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """Per ``key`` its rows in order, as one list."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", *columns))).alias("listed"))


def wiki(states: DataFrame, transitions: DataFrame, skips: DataFrame, folder: str, target: str) -> list[str]:
    """A static site of a map: indexes with a diagram each, a page per state and per transition.

    Pages are put together in Spark and written one by one as they come; the driver holds one
    page of a state, and the diagram of ``PAGE_STATES`` states.
    """
    out, esc, names = Path(folder), html.escape, []
    out.mkdir(parents=True, exist_ok=True)

    def put(name: str, body: str) -> None:
        (out / name).write_text(body, encoding="utf-8")
        names.append(name)

    label = action_label(mermaid_text(redact(F.col("name"))))
    moves = transitions.select("seq", "src", "dst", "role", label.alias("label"))
    held = skips.select("src", redact(F.col("name")).alias("name"), redact(F.col("reason")).alias("reason"), "seq")
    ends = states.select(F.col("state_id").alias("dst"), F.col("seq").alias("at"))
    leads = _listed(moves.join(ends, "dst", "left"), "src", "label", "at").withColumnsRenamed({"src": "state_id", "listed": "leads"})
    kept = _listed(held, "src", "name", "reason").withColumnsRenamed({"src": "state_id", "listed": "held"})
    views = redact_frame(states.select("seq", "state_id", "actions")).join(leads, "state_id", "left").join(kept, "state_id", "left")
    rows = views.select("seq", short_id(F.col("state_id")).alias("label"), "actions", "leads", "held").orderBy("seq").toLocalIterator()
    page, nodes, edges, entries = 0, [], [], []

    def index(last: bool) -> None:
        nonlocal page, nodes, edges, entries
        more = "" if last else f"<p><a href='index-{page + 2}.html'>More states</a></p>"
        diagram = chr(10).join(["graph TD", *nodes, *edges])
        put("index.html" if page == 0 else f"index-{page + 1}.html", _page(target, f"<pre class='mermaid'>{diagram}</pre><ul>{''.join(entries)}</ul>{more}"))
        page, nodes, edges, entries = page + 1, [], [], []

    for r in rows:
        if len(nodes) == PAGE_STATES:
            index(False)
        nodes.append(f'    S{r["seq"]}["{esc(r["label"])}"]')
        edges += [f'    S{r["seq"]} -->|{esc(x["label"])}| S{x["at"]}' for x in r["leads"] or () if x["at"] is not None]
        entries.append(f"<li><a href='state-{r['seq']}.html'>{esc(r['label'])}</a></li>")
        actions = "".join(f"<li>{esc(a['role'] or '')}: {esc(a['name'] or '(unnamed)')}</li>" for a in r["actions"] or [])
        ways = "".join(f"<li><a href='transition-{x['seq']}.html'>{esc(x['label'])}</a></li>" for x in r["leads"] or ())
        back = "".join(f"<li>{esc(x['name'] or '')}: {esc(x['reason'] or '')}</li>" for x in r["held"] or ())
        put(f"state-{r['seq']}.html", _page(r["label"], f"<h2>Actions</h2><ul>{actions}</ul><h2>Leads to</h2><ul>{ways}</ul><h2>Held back</h2><ul>{back}</ul>"))
    index(True)
    for x in moves.orderBy("seq").toLocalIterator():
        two = "".join(f"<p>{w}: {esc(str(x[c]))[:12]}</p>" for w, c in (("From", "src"), ("To", "dst")))
        put(f"transition-{x['seq']}.html", _page(x["label"], two + f"<p>Fires {esc(x['role'] or '')}</p>"))
    return sorted(names)


def test_suite(paths: DataFrame, transitions: DataFrame, folder: str) -> list[str]:
    """A pytest file per transition that replays the way to it; nothing for an empty map.

    ``paths``: state, steps; ``transitions``: seq, src, role, name, dst.
    """
    rows = redact_frame(transitions.join(paths.select(F.col("state").alias("src"), "steps"), "src").select("seq", "src", "role", "name", "dst", "steps")).orderBy("seq").toLocalIterator()
    first = next(rows, None)
    if first is None:
        return []
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    (out / "conftest.py").write_text("import pytest\n\n\n@pytest.fixture\ndef driver():\n    pytest.skip('bind a browser driver here')\n", encoding="utf-8")
    names = ["conftest.py"]
    for r in chain([first], rows):
        steps = [(x["role"], x["name"], x["landed"]) for x in r["steps"]] + [(r["role"], r["name"], r["dst"])]
        body = f"STEPS = {json.dumps(steps, ensure_ascii=False, indent=4)}\n\n\ndef test_transition_{r['seq']}(driver):\n    driver.reset()\n    for role, name, landed in STEPS:\n        driver.perform(role, name)\n        assert driver.state_id() == landed\n"
        names.append(f"test_transition_{r['seq']}.py")
        (out / names[-1]).write_text(body, encoding="utf-8")
    return names


def scaffold(actions: DataFrame) -> str | None:
    """YAML of the fields, logins and destructive actions of a map, to be filled in by hand.

    ``actions``: state_id, pos, role, name, input_type.
    """
    kind = field_kind(F.col("role"), F.col("input_type"))
    a = actions.select(F.substring("state_id", 1, 12).alias("state"), "pos", "role", redact(F.col("name")).alias("name"), "input_type", kind.alias("k"), is_destructive(F.col("name"), F.col("role")).alias("bad"))
    rows = a.filter(F.col("role").isin(*FIELD_ROLES) | F.col("bad")).orderBy("state", "pos").collect()
    if not rows:
        return None
    q = lambda v: json.dumps(v, ensure_ascii=False)
    fields = [r for r in rows if r["role"] in FIELD_ROLES and r["input_type"] != "password"]
    logins = sorted({r["state"] for r in rows if r["input_type"] == "password"})
    risky = [r for r in rows if r["bad"]]
    lines = ["fields:" if fields else "fields: []"]
    for r in fields:
        lines += [f"  - state: {q(r['state'])}", f"    name: {q(r['name'])}", f"    kind: {r['k']['kind']}", f"    note: {q(r['k']['note'])}", f"    example: {q(r['k']['example'])}", "    value:", "    generate: false"]
    lines += ["login_points:" if logins else "login_points: []"] + [f"  - state: {q(s)}" for s in logins]
    lines += ["destructive_actions:" if risky else "destructive_actions: []"]
    for r in risky:
        lines += [f"  - state: {q(r['state'])}", f"    name: {q(r['name'])}", f"    role: {r['role']}"]
    return "\n".join(lines) + "\n"


def resource_report(trace: DataFrame, title: str) -> str:
    """A page with a run's transactions as a table."""
    rows = trace.toLocalIterator()
    head = "".join(f"<th>{html.escape(c)}</th>" for c in trace.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r) + "</tr>" for r in rows)
    return _page(title, f"<table><tr>{head}</tr>{body}</table>")
