"""Finding elements again after their selector broke.

A stored fingerprint is scored against every element of a page (or of a row, for a
listing). Prior fingerprints go to the pages whole where they are counted to be few, else
they meet in a join by domain; one Arrow map scores a page's candidates, since parsing the
page is the expensive part. In a listing scores follow from an element's mark and are kept.
"""

from __future__ import annotations

from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow import array, column_map
from ..session import staged
from . import dom
from .extract import first, typed, value_of
from .jobs import Job

#: Weights of the signals, and the score that counts as found.
WEIGHTS = {"tag": 1.5, "id": 3.0, "classes": 1.0, "attrs": 1.0, "text": 3.0, "ancestors": 1.5, "sibling": 0.5, "descendants": 2.0, "visual": 2.0}
THRESHOLD = 0.6
RUNNERS_UP = 4
VISUAL_RERANK = 5
#: Characters of stored fingerprints (as JSON) that go to every task; more are joined by domain.
MAX_KNOWN = 1 << 20
#: Pages of a domain from which the join spreads it, and over how many parts.
HOT_DOMAIN, SPREAD = 100_000, 64
#: Scores that a task keeps by mark, and last pages by key.
KEPT = 1 << 14

PRINT_DDL = (
    "struct<tag:string,element_id:string,classes:array<string>,attrs:map<string,string>,text:string,"
    "ancestors:array<string>,sibling_index:int,descendants:map<string,int>,visual_hash:bigint>"
)
_PRINT = pa.struct(
    [
        ("tag", pa.string()), ("element_id", pa.string()), ("classes", pa.list_(pa.string())), ("attrs", pa.map_(pa.string(), pa.string())),
        ("text", pa.string()), ("ancestors", pa.list_(pa.string())), ("sibling_index", pa.int32()),
        ("descendants", pa.map_(pa.string(), pa.int32())), ("visual_hash", pa.int64()),
    ]
)


def _share(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a or b else 1.0


def _counts(a: dict, b: dict) -> float:
    tags = a.keys() | b.keys()
    most = sum(max(a.get(t, 0), b.get(t, 0)) for t in tags)
    return sum(min(a.get(t, 0), b.get(t, 0)) for t in tags) / most if most else 1.0


@lru_cache(maxsize=1 << 14)
def _alike(a: tuple, b: tuple) -> float:
    return SequenceMatcher(None, a, b).ratio()


def _bits(a: int, b: int) -> float:
    return 1.0 - ((a ^ b) & 0xFFFFFFFFFFFFFFFF).bit_count() / 64


def score(old: dict, new: dict) -> float:
    """Weighted mean of the signals that apply; what the old element lacked doesn't count.

    Tag, ancestors and sibling position always count; an image hash where both have one.
    """
    w = WEIGHTS
    total = w["tag"] + w["ancestors"] + w["sibling"]
    got = w["tag"] * (old["tag"] == new["tag"]) + w["ancestors"] * _alike(tuple(old["ancestors"]), tuple(new["ancestors"]))
    got += w["sibling"] / (1.0 + abs(old["sibling_index"] - new["sibling_index"]))
    if old["element_id"]:
        total += w["id"]
        got += w["id"] * (old["element_id"] == new["element_id"])
    if old["classes"]:
        total += w["classes"]
        got += w["classes"] * _share(set(old["classes"]), set(new["classes"]))
    if old["attrs"]:
        total += w["attrs"]
        got += w["attrs"] * _share(set(old["attrs"].items()), set(new["attrs"].items()))
    if old["text"]:
        total += w["text"]
        got += w["text"] * (1.0 if old["text"] == new["text"] else SequenceMatcher(None, old["text"], new["text"]).ratio())
    if old["descendants"]:
        total += w["descendants"]
        got += w["descendants"] * _counts(old["descendants"], new["descendants"])
    if old.get("visual_hash") is not None and new.get("visual_hash") is not None:
        total += w["visual"]
        got += w["visual"] * _bits(old["visual_hash"], new["visual_hash"])
    return got / total


@dataclass
class Healed:
    index: int
    score: float
    confident: bool
    runners_up: list[tuple[int, float]]
    node: dom.Node

    def explain(self) -> str:
        verdict = "confident" if self.confident else "UNCERTAIN"
        rest = ", ".join(f"#{i}={s:.3f}" for i, s in self.runners_up) or "none"
        return f"healed to candidate #{self.index} score={self.score:.3f} ({verdict}); runners-up: {rest}"


def heal(
    old: dict, candidates: list[dom.Node], threshold: float = THRESHOLD, with_text: bool = True, hashes: dict[int, int] | None = None, known: dict[int, dict] | None = None,
    scores: list[float] | None = None,
) -> Healed | None:
    """Best candidate for a stored fingerprint, earlier ones winning ties; None without candidates.

    Where the stored element and ``hashes`` (by candidate) have images, the best five
    are scored again with them. ``known``: the page's fingerprints, where made already;
    ``scores``: the candidates', which take the place of fingerprints where there are no ``hashes``.
    """
    if not candidates:
        return None
    if scores is None:
        prints = [known[id(c)] if known else dom.fingerprint(c, with_text) for c in candidates]
        scores = [score(old, p) for p in prints]
    ranked = sorted((-s, i) for i, s in enumerate(scores))
    if old.get("visual_hash") is not None and hashes:
        again = {i: -score(old, prints[i] | {"visual_hash": hashes[i]}) for _, i in ranked[:VISUAL_RERANK] if hashes.get(i) is not None}
        ranked = sorted((again.get(i, s), i) for s, i in ranked)
    best, at = ranked[0]
    runners = [(i, -s) for s, i in ranked[1 : 1 + RUNNERS_UP]]
    return Healed(at, -best, -best >= threshold, runners, candidates[at])


def container_groups(old: dict, candidates: list[dom.Node], threshold: float = THRESHOLD, scores: list[float] | None = None) -> tuple[list[list[dom.Node]], float, bool]:
    """Groups of two or more confident siblings of one tag, the best score, and whether any was confident.

    ``scores``: the candidates', where known already."""
    best, any_confident, groups = 0.0, False, {}
    if scores is None:
        scores = [score(old, dom.fingerprint(c, False)) for c in candidates]
    for c, s in zip(candidates, scores):
        best = max(best, s)
        if s >= threshold:
            any_confident = True
            if c.parent is not None:
                groups.setdefault((id(c.parent), c.tag), []).append(c)
    return [g for g in groups.values() if len(g) >= 2], best, any_confident


def locator(node: dom.Node) -> str:
    """A selector for a found element: id, else tag with classes, else tag."""
    if node.attrs.get("id"):
        return "#" + node.attrs["id"]
    classes = node.attrs.get("class", "").split()
    return ".".join([node.tag, *classes])


_SEEN = pa.schema([("domain", pa.string()), ("key", pa.string()), ("print", _PRINT)])
SEEN_DDL = f"domain string, key string, print {PRINT_DDL}"


def _flat(p: dict) -> dict:
    return p | {"attrs": list(p["attrs"].items()), "descendants": list(p["descendants"].items())}


def _known(p: dict) -> dict:
    return p | {"attrs": dict(p["attrs"] or ()), "descendants": dict(p["descendants"] or ())}


def _rows(page: dom.Node, job: Job) -> list[dom.Node]:
    return dom.select(page, job.item) if job.item else [page]


def remember(pages: DataFrame, job: Job) -> DataFrame:
    """(domain, key, print) of the elements a job's selectors hit, the last page per key winning.

    ``pages``: domain, seq, html. In a listing, keys carry the item selector, texts are
    left out, and the first row is kept as the container's fingerprint.
    """
    schema = pa.schema([("domain", pa.string()), ("seq", pa.int64()), ("n", pa.int32()), ("key", pa.string()), ("print", _PRINT)])

    keys = [*([f"{job.item}::"] if job.item else []), *(f"{job.item}::{name}" if job.item else name for name in job.fields)]

    def walk(last, domains, seqs, texts):
        out: list[list] = [[] for _ in schema]
        for domain, seq, text in zip(domains, seqs, texts):
            # n of a key is its place in keys at most: a page that can't come last for any key isn't parsed
            if seq is not None and all(last.get((domain, key), (seq, -1)) >= (seq, n) for n, key in enumerate(keys)):
                continue
            page = dom.parse(text)
            roots = _rows(page, job)
            found = {f"{job.item}::": roots[0]} if job.item and roots else {}
            for name, spec in job.fields.items():
                node = next((n for n in (first(r, spec.selector) for r in reversed(roots)) if n is not None), None)
                if node is not None:
                    found[f"{job.item}::{name}" if job.item else name] = node
            prints = dom.fingerprints(page, not job.item) if found else {}
            if len(last) > KEPT:
                last.clear()
            for n, (key, node) in enumerate(found.items()):
                if seq is not None:
                    if last.get((domain, key), (seq, -1)) >= (seq, n):
                        continue
                    last[domain, key] = (seq, n)
                for c, v in zip(out, (domain, seq, n, key, _flat(prints[id(node)]))):
                    c.append(v)
        return out

    def run(batches):
        yield from column_map(partial(walk, {}), schema, 64)(batches)

    rows = pages.select("domain", F.col("seq").cast("bigint"), "html").mapInArrow(run, f"domain string, seq bigint, n int, key string, print {PRINT_DDL}")
    return rows.groupBy("domain", "key").agg(F.max_by("print", F.struct("seq", "n")).alias("print"))


def prior(fingerprints: DataFrame, run_seq: int) -> DataFrame:
    """What earlier runs stored, the latest per key: a run never heals from itself."""
    order = Window.partitionBy("domain", "key").orderBy(F.col("run_seq").desc())
    return fingerprints.filter(F.col("run_seq") < run_seq).withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


_HEALED = pa.schema(
    [
        ("domain", pa.string()), ("seq", pa.int64()), ("pos", pa.int32()), ("field", pa.string()), ("value", pa.string()),
        ("healed", pa.bool_()), ("score", pa.float64()), ("used", pa.bool_()), ("new_locator", pa.string()), ("print", _PRINT),
    ]
)
HEALED_DDL = (
    "domain string, seq bigint, pos int, field string, value string, healed boolean, score double, used boolean, "
    f"new_locator string, print {PRINT_DDL}"
)


def heal_extract(pages: DataFrame, job: Job, stored: DataFrame) -> DataFrame:
    """(domain, seq, pos, field, value, ...): every field, healed where its selector misses.

    ``stored``: (domain, key, print) of earlier runs. ``healed`` marks a field that was
    looked for by fingerprint; ``used`` one that was found with confidence, and only
    then has it a value and a new ``print``. Where the item selector misses, the rows
    are the single confident group of siblings; a refusal is a row of its own with
    ``pos`` -1 when something came close.
    """

    item = job.item
    of_field = {name: f"{item}::{name}" if item else name for name in job.fields}

    def walk(few, cache, domains, seqs, texts, *joined):
        out: list[list] = [[] for _ in range(len(_HEALED) - 1)]
        at: list[int | None] = []
        values: list[dict] = []
        same: dict[dom.Mark, int] = {}

        def put(*row, print=None):
            for c, v in zip(out, row):
                c.append(v)
            at.append(print)

        for domain, seq, text, *own in zip(domains, seqs, texts, *joined):
            if cache.get("domain", cache) != domain:
                known = few.get(domain, {}) if few is not None else {k: _known(p) for k, p in zip(*(x or () for x in own))}
                cache.update(domain=domain, known=known, scores={})
            known, kept = cache["known"], cache["scores"]
            page = dom.parse(text)
            roots = _rows(page, job)
            container = known.get(f"{item}::")
            made: dict = {}

            def all_made(page=page, made=made):
                if not made:
                    made.update(dom.marks(page) if item else dom.fingerprints(page))
                return made

            def scored(key, nodes):
                own, made, old = kept.setdefault(key, {}), all_made(), known[key]
                if len(own) > KEPT:
                    own.clear()
                got = []
                for node in nodes:
                    mark = made[id(node)]
                    s = own.get(mark)
                    if s is None:
                        s = own[mark] = score(old, dom.marked(mark))
                    got.append(s)
                return got

            def print_at(node):
                mark = all_made()[id(node)]
                i = same.get(mark) if item else None
                if i is None:
                    i = len(values)
                    values.append(_flat(dom.marked(mark) if item else mark))
                    if item:
                        same[mark] = i
                return i

            if item and not roots and container:
                nodes = list(page.iter())
                groups, best, close = container_groups(container, nodes, scores=scored(f"{item}::", nodes))
                if len(groups) == 1:
                    roots = groups[0]
                    put(domain, seq, -1, item, None, True, best, True, locator(roots[0]), print=print_at(roots[0]))
                elif close:
                    put(domain, seq, -1, item, None, True, best, False, None)
            for pos, root in enumerate(roots):
                for name, spec in job.fields.items():
                    node = first(root, spec.selector)
                    if node is not None:
                        put(domain, seq, pos, name, value_of(node, spec), False, None, None, None)
                        continue
                    key = of_field[name]
                    old, pool = known.get(key), list(root.iter())[1 if item else 0 :]
                    found = None
                    if old:
                        found = heal(old, pool, scores=scored(key, pool)) if item else heal(old, pool, known=all_made())
                    if found is None:
                        put(domain, seq, pos, name, None, False, None, None, None)
                    else:
                        ok = found.confident
                        put(
                            domain, seq, pos, name, value_of(found.node, spec) if ok else None, True, found.score, ok,
                            locator(found.node), print=print_at(found.node) if ok else None,
                        )
        return [*out, array(values, _PRINT).take(pa.array(at, pa.int32()))] if at else []

    stored = staged(stored.select("domain", "key", "print"), "fingerprints")
    size = stored.agg(F.sum(F.length(F.to_json(F.struct("domain", "key", "print"))))).first()[0] or 0
    rows = pages.select("domain", F.col("seq").cast("bigint").alias("seq"), "html")
    few: dict[str, dict] | None = None
    if size <= MAX_KNOWN:
        few = {}
        for r in stored.filter("domain is not null").collect():
            few.setdefault(r["domain"], {})[r["key"]] = _known(r["print"].asDict(recursive=True))
    else:
        by_domain = stored.groupBy("domain").agg(F.collect_list("key").alias("keys"), F.collect_list("print").alias("prints"))
        hot = [r["domain"] for r in rows.groupBy("domain").count().filter(F.col("count") >= HOT_DOMAIN).collect() if r["domain"] is not None]
        part = lambda many, one: F.when(F.col("domain").isin(hot), many).otherwise(one)
        by_part = by_domain.withColumn("_part", F.explode(part(F.sequence(F.lit(0), F.lit(SPREAD - 1)), F.array(F.lit(0)))))
        rows = rows.withColumn("_part", part(F.pmod(F.xxhash64("html"), F.lit(SPREAD)).cast("int"), F.lit(0))).join(by_part, ["domain", "_part"], "left").select("domain", "seq", "html", "keys", "prints")

    def run(batches):
        yield from column_map(partial(walk, few, {}), _HEALED, 128)(batches)

    return rows.mapInArrow(run, HEALED_DDL)


def records(healed: DataFrame, urls: DataFrame, job: Job) -> DataFrame:
    """Records of pages by selector, with healed values where a selector gave none, and the rows of healed listings.

    ``healed``: :func:`heal_extract`, which reads every field of every row, so no page is parsed again; ``urls``:
    (url, seq) of its pages. Values found without confidence stay null.
    """
    value = lambda name: F.max(F.when(F.col("field") == name, F.col("value")))  # noqa: E731  # one row per field
    wide = healed.filter("pos >= 0").groupBy("seq", "pos").agg(F.array(*(value(name) for name in job.fields)).alias("_v"))
    # urls are far more than the size of their file shows: never broadcast by it
    found = wide.join(urls.select("url", "seq").hint("merge"), "seq")
    return found.select("url", "pos", *typed(job, F.col("_v")))


def heal_events(healed: DataFrame) -> DataFrame:
    """Every attempt to heal, confident or not."""
    return healed.filter("healed").select("domain", "seq", "pos", "field", "score", "used", "new_locator")


def heal_counts(events: DataFrame) -> DataFrame:
    return events.agg(F.count_if("used").alias("confident"), F.count_if(~F.col("used")).alias("uncertain"))
