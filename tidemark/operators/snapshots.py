"""What changed between consecutive full snapshots, by a bucketed key-to-hash index.

:func:`read_snapshots` parses every snapshot once and keeps, per snapshot, the hash of each
key's record apart from its values. The *index* of a snapshot holds its keys and hashes
only, bucketed by (snapshot, key), so no snapshot, url or key is one task's. A step
*probes* the index of the last snapshot with the keys and hashes of the new one; that alone
tells added and removed keys, and which keys may have changed. Only for the latter
are *old values fetched* and compared field by field. Then the indexes *swap*: the new
snapshot's index is what the next one is probed against. :class:`.delivery.SnapshotIndex`
does one step for one delivery; :func:`changes` unrolls all steps of a history at once, since
the swap only says which snapshot's index is read by which probe. Both share :func:`probe`.
"""

from __future__ import annotations

from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import column_map
from ..functions.jsontext import canonical, key_text, records_of
from ..session import small, staged, staged_buckets
from .history import consecutive, instant_us, standing

_ENTRY = pa.struct([("sku", pa.string()), ("h", pa.int64())])
_INDEX = pa.schema(
    [
        ("run_id", pa.int64()),
        ("url", pa.string()),
        ("ts", pa.int64()),
        ("fields", pa.list_(pa.string())),
        ("kinds", pa.list_(pa.string())),
        ("keys", pa.list_(_ENTRY)),
        ("vals", pa.list_(pa.list_(pa.string()))),
    ]
)
INDEX_DDL = (
    "run_id bigint, url string, ts bigint, fields array<string>, kinds array<string>, "
    "keys array<struct<sku:string,h:bigint>>, vals array<array<string>>"
)


def summarise(text: str | None, key: str = "sku") -> tuple[list, list, list, list] | None:
    """Fields, their types, key hashes and canonical values of one snapshot's records.

    ``fields``: top-level names with a text or number in some record, sorted;
    ``kinds``: ``number`` where all are numbers, else ``string``. A key stands for
    its first record; records with a null key count for ``fields`` only. None when
    the text isn't a list of records.
    """
    records = records_of(text)
    if records is None:
        return None
    kinds: dict[str, str] = {}
    first: dict[str, dict] = {}
    for record in records:
        if type(record) is not dict:
            continue
        own = {}
        for name, value in record.items():
            scalar = canonical(value)
            if scalar is not None:
                own[name] = scalar
                kind = "string" if type(value) is str else "number"
                if kinds.get(name, kind) != kind:
                    kind = "string"
                kinds[name] = kind
        sku = key_text(record.get(key))
        if sku is not None and sku not in first:
            first[sku] = own
    fields = sorted(kinds)
    keys, vals = [], []
    for sku, own in first.items():
        row = [own.get(f) for f in fields]
        items = "\x1f".join(f"{f}\x1e{v}" for f, v in zip(fields, row) if v is not None)
        digest = blake2b(items.encode("utf-8", "surrogatepass"), digest_size=8).digest()
        keys.append({"sku": sku, "h": int.from_bytes(digest, "big", signed=True)})
        vals.append(row)
    return fields, [kinds[f] for f in fields], keys, vals


def snapshot_rows(runs: DataFrame, key: str = "sku") -> DataFrame:
    """One row per run with its url, instant and :func:`summarise`; null arrays for no records."""

    def walk(ids: list, urls: list, times: list, texts: list) -> list[list]:
        found = [summarise(t, key) or (None, None, None, None) for t in texts]
        return [ids, urls, times, *(list(c) for c in zip(*found))]

    slim = runs.select(
        F.col("id").cast("bigint").alias("run_id"), "url", instant_us(F.col("captured_at")).alias("ts"), "records_json"
    )
    return slim.mapInArrow(column_map(walk, _INDEX), INDEX_DDL)


def read_snapshots(runs: DataFrame, key: str = "sku") -> DataFrame:
    """Every run's key hashes and values, parsed once and kept in the shared folder."""
    return staged(snapshot_rows(runs, key), "snapshots")


def steps(snaps: DataFrame) -> DataFrame:
    """(new_id, prev_id) of consecutive records snapshots of each url.

    Of rows with one url and instant the highest id stands, even where its records
    are broken; a snapshot needs a record with a key.
    """
    slim = snaps.select("run_id", "url", "ts", (F.coalesce(F.size("keys"), F.lit(0)) > 0).alias("valid"))
    kept = standing(slim, "url", "ts", "run_id").filter("valid")
    return consecutive(kept, "url", "ts", "run_id")


def probe(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` with hashes ``new_h`` and ``old_h`` of what isn't the same on both sides.

    ``new`` and ``old`` have the keys and a hash ``h`` of each row, keys once on each side.
    """
    both = new.withColumnRenamed("h", "new_h").join(old.withColumnRenamed("h", "old_h"), keys, "full_outer")
    return both.filter(~F.col("new_h").eqNullSafe(F.col("old_h")))


def _verify(snaps: DataFrame, suspects: DataFrame) -> DataFrame:
    """Of suspect keys those with an unequal value in a field that both snapshots have."""
    roles = F.inline(F.array(*(F.struct(F.col(c).alias("run_id"), F.lit(c == "new_id").alias("is_new")) for c in ("new_id", "prev_id"))))
    wanted = staged(suspects.select("new_id", "sku", roles), "snapshot_suspects")
    entry = F.inline(F.arrays_zip(F.col("keys.sku").alias("sku"), F.col("vals").alias("v")))
    values = snaps.join(small(wanted.select("run_id").distinct()), "run_id", "left_semi").select("run_id", "fields", entry)
    picked = wanted.join(values, ["run_id", "sku"])
    pair = picked.groupBy("new_id", "sku").agg(
        *(F.max(F.when(cond, F.struct("fields", "v"))).alias(name) for name, cond in (("new", F.col("is_new")), ("old", ~F.col("is_new"))))
    )
    value = lambda side, f: F.element_at(F.col(f"{side}.v"), F.array_position(F.col(f"{side}.fields"), f).cast("int"))
    shared = F.array_intersect("new.fields", "old.fields")
    differs = F.exists(shared, lambda f: ~value("new", f).eqNullSafe(value("old", f)))
    return pair.filter(differs).select("new_id", "sku")


def _links(snaps: DataFrame) -> DataFrame:
    """(run_id, prev_id, next_id, same): each snapshot's neighbours, and whether the one before has its fields."""
    pairs = staged(steps(snaps), "snapshot_steps")
    schema = snaps.select("run_id", F.xxhash64(F.concat_ws("\x1f", "fields")).alias("f"))
    both = pairs.join(schema.withColumnsRenamed({"run_id": "new_id", "f": "nf"}), "new_id").join(schema.withColumnsRenamed({"run_id": "prev_id", "f": "of"}), "prev_id")
    back = both.select(F.col("new_id").alias("run_id"), "prev_id", (F.col("nf") == F.col("of")).alias("same"))
    ahead = pairs.select(F.col("prev_id").alias("run_id"), F.col("new_id").alias("next_id"))
    return staged(back.join(ahead, "run_id", "full_outer").select("run_id", "prev_id", "next_id", "same"), "snapshot_links")


def changes(snaps: DataFrame) -> DataFrame:
    """(run_id, sku, change_kind) between all consecutive snapshots of :func:`read_snapshots`.

    ``added``/``removed``: the key is in one of the two only; ``changed``: some text
    or number field both snapshots have differs in value. Where both have the same fields
    unequal hashes say so; else the values of both sides are fetched. No snapshots give no
    rows; a url's first snapshot gives none.
    """
    hashes = snaps.select("run_id", "keys").join(small(_links(snaps)), "run_id").select("run_id", "prev_id", "next_id", "same", F.inline("keys"))
    old = hashes.filter("next_id is not null").select(F.col("run_id").alias("prev_id"), "sku", "h", F.col("next_id").alias("_next"))
    index = staged_buckets(old, "snapshot_index", ["prev_id", "sku"])
    new = hashes.filter("prev_id is not null").select("prev_id", "sku", "h", F.col("run_id").alias("_new"), "same")
    hit = probe(new, index, ["prev_id", "sku"]).withColumn("new_id", F.coalesce("_new", "_next"))
    kind = F.when(F.col("old_h").isNull(), "added").when(F.col("new_h").isNull(), "removed").when(F.col("same"), "changed")
    probed = staged(hit.select("new_id", "prev_id", "sku", kind.alias("change_kind")).distinct(), "snapshot_probe")
    sure = probed.filter("change_kind is not null").select(F.col("new_id").alias("run_id"), "sku", "change_kind")
    changed = _verify(snaps, probed.filter("change_kind is null"))
    return sure.unionByName(changed.select(F.col("new_id").alias("run_id"), "sku", F.lit("changed").alias("change_kind")))


def snapshot_changes(runs: DataFrame) -> DataFrame:
    """:func:`changes` over the records snapshots of a run history.

    Null, empty and unparsable records, null urls and unreadable times make no snapshot. Of
    rows with one url and instant (repeated runs too) the highest id stands. Of records with
    one sku the first stands; records without one are left out. Texts are compared whole,
    however long. An empty table gives no rows; other columns of ``runs`` are not read.
    """
    return changes(read_snapshots(runs))
