"""Plain-Python versions of the core problems, written from their statements."""

import json
import re
from collections import defaultdict
from datetime import datetime, timezone
from decimal import Decimal

LISTS = ("variants", "offers", "seasons", "episodes", "actions", "skipped")


def load(text):
    if text is None:
        return None
    try:
        v = json.loads(text)
        return json.loads(v) if isinstance(v, str) else v
    except ValueError:
        return None


def records(text):
    v = load(text)
    return [v] if isinstance(v, dict) else v if isinstance(v, list) else None


def nested(rows):
    out = set()

    def down(run, col, obj, path, parent):
        if isinstance(obj, list):
            for i, x in enumerate(obj):
                down(run, col, x, f"{path}[{i}]", parent)
        elif isinstance(obj, dict):
            out.add((run, col, path, parent))
            inside(run, col, obj, path + ".", path)

    def inside(run, col, obj, prefix, parent):
        for k, v in obj.items():
            if k in LISTS and isinstance(v, dict):
                v = [v]
            down(run, col, v, prefix + k, parent)

    for r in rows:
        recs = records(r["records_json"])
        if recs is not None:
            down(r["id"], "records_json", recs, "", "")
        for col in ("api_surface_json", "exploration_json"):
            v = load(r[col])
            if isinstance(v, dict):
                inside(r["id"], col, v, "", "")
    return out


def instant(text):
    if text is None:
        return None
    try:
        t = datetime.fromisoformat(text)
    except ValueError:
        return None
    return t if t.tzinfo else t.replace(tzinfo=timezone.utc)


def number(v):
    if isinstance(v, bool):
        return None
    if isinstance(v, (int, float)):
        return Decimal(repr(v))
    if isinstance(v, str) and re.fullmatch(r"[+-]?[0-9]+(\.[0-9]+)?", v):
        return Decimal(v)
    return None


def equal(a, b):
    if isinstance(a, str) and isinstance(b, str) and a == b:
        return True
    x, y = number(a), number(b)
    if x is not None and y is not None:
        return x == y
    return type(a) is type(b) and a == b


def scalar(v):
    return v if isinstance(v, (str, int, float)) and not isinstance(v, bool) else None


def steps(rows, valid):
    by = defaultdict(dict)
    for r in rows:
        t = instant(r["captured_at"])
        if t is not None and r["url"] is not None:
            cur = by[r["url"]].get(t)
            if cur is None or cur["id"] < r["id"]:
                by[r["url"]][t] = r
    for at in by.values():
        good = [at[t] for t in sorted(at) if valid(at[t])]
        yield from zip(good, good[1:])


def _has_sku(r):
    recs = records(r["records_json"])
    return recs is not None and any(isinstance(x, dict) and x.get("sku") is not None for x in recs)


def _first(r):
    out = {}
    for x in records(r["records_json"]):
        if isinstance(x, dict) and x.get("sku") is not None:
            out.setdefault(x["sku"], x)
    return out


def _kinds(r):
    out = {}
    for x in records(r["records_json"]):
        if isinstance(x, dict):
            for k, v in x.items():
                if scalar(v) is not None:
                    out[k] = "string" if isinstance(v, str) else "number"
    return out


def changed(rows):
    out = set()
    for old, new in steps(rows, _has_sku):
        a, b = _first(old), _first(new)
        shared = set(_kinds(old)) & set(_kinds(new))
        for s in b:
            if s not in a:
                out.add((new["id"], s, "added"))
            else:
                for f in shared:
                    u, v = scalar(a[s].get(f)), scalar(b[s].get(f))
                    if (u is None) != (v is None) or u is not None and not equal(u, v):
                        out.add((new["id"], s, "changed"))
        for s in a:
            if s not in b:
                out.add((new["id"], s, "removed"))
    return out


def drift(rows):
    """Report rows; where content leaves a rename open, the step's run id is in the second result."""
    out, open_ = set(), set()

    def put(run, col, old, new, same):
        lost, came = [f for f in old if f not in new], [f for f in new if f not in old]
        pairs = [(a, b) for a in lost for b in came if same(a, b)]
        if len({a for a, _ in pairs}) < len(pairs) or len({b for _, b in pairs}) < len(pairs):
            open_.add((run, col))
            return
        for a, b in pairs:
            out.add((run, col, b, a, "renamed"))
            if old[a] != new[b]:
                out.add((run, col, b, a, "retyped"))
        out.update((run, col, b, b, "added") for b in came if b not in [p[1] for p in pairs])
        out.update((run, col, a, a, "removed") for a in lost if a not in [p[0] for p in pairs])
        out.update((run, col, f, f, "retyped") for f in old if f in new and old[f] != new[f])

    for old, new in steps(rows, _has_sku):
        a, b = _first(old), _first(new)

        def same(f, g):
            n = hits = 0
            for s in a:
                if s in b:
                    u, v = scalar(a[s].get(f)), scalar(b[s].get(g))
                    if u is not None or v is not None:
                        n += 1
                        hits += u is not None and v is not None and equal(u, v)
            return hits * 2 > n

        put(new["id"], "records_json", _kinds(old), _kinds(new), same)

    def options(r):
        kinds, content = {}, {}
        for k, v in load(r["config_json"]).items():
            if k == "fields":
                for n, spec in v.items():
                    kinds[f"fields.{n}"] = spec.get("type") or "string"
                    content[f"fields.{n}"] = ("fields", spec.get("selector"), spec.get("attr"))
            elif isinstance(v, dict):
                for n, x in v.items():
                    if x is not None:
                        kinds[f"{k}.{n}"], content[f"{k}.{n}"] = _kind(x), (k, x)
            elif v is not None:
                kinds[k], content[k] = _kind(v), ("", v)
        return kinds, content

    for old, new in steps(rows, lambda r: isinstance(load(r["config_json"]), dict)):
        (ka, ca), (kb, cb) = options(old), options(new)
        put(new["id"], "config_json", ka, kb, lambda f, g: ca[f][0] == cb[g][0] and all(equal(u, v) for u, v in zip(ca[f][1:], cb[g][1:])))
    return out, open_


def _kind(v):
    return "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "array" if isinstance(v, list) else "string"
