"""Duplicates hidden by spelling: dictionary-encoded records, grouped as integer tuples.

Each column becomes a dictionary: its distinct values are canonicalised once each and
distinct canonical forms get integer identifiers. Records are rewritten as tuples of
integers in the order of the sorted field names (0 for null), and the compact tuples
are grouped instead of texts. The identifiers are written down before they are used,
so a lost executor can't renumber them.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import column_map
from ..session import staged

#: A dictionary of at most so many entries and characters is broadcast; larger ones are joined by key.
BROADCAST_ROWS = 50_000
BROADCAST_CHARS = 4_000_000
#: Copies in a group from which its join back to the rows is salted, and the salts.
HOT_GROUP = 1_000_000
SALTS = 64

_ASCII_DROP = re.compile(r"(?<![0-9])[.,]|[.,](?![0-9])|[^a-z0-9.,]+")


def fold(text: str) -> str:
    """Letters and digits in order, without case; accents composed or not are the same.

    Blanks, punctuation, symbols and invisible characters are dropped, but a point or
    comma directly between two digits stays. Combining marks that belong to a letter
    count as part of it.
    """
    if text.isascii():
        return _ASCII_DROP.sub("", text.lower())
    text = unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).casefold())
    out = []
    last = len(text) - 1
    for i, c in enumerate(text):
        if c.isalpha() or c.isdecimal():
            out.append(c)
        elif c in ".,":
            if 0 < i < last and text[i - 1].isdecimal() and text[i + 1].isdecimal():
                out.append(c)
        elif unicodedata.category(c)[0] in "MN" and (unicodedata.category(c) in ("Mc", "Nl", "No") or unicodedata.combining(c)):
            out.append(c)
    return "".join(out)


_FOLDED = pa.schema([("field", pa.int32()), ("raw", pa.string()), ("n", pa.int64()), ("canon", pa.string())])


def _as_text(column: Column, kind: str) -> Column:
    """Doubles as text with one form per number (-0 is 0), other types as they are."""
    if kind in ("double", "float"):
        column = F.when(column == 0, F.lit(0.0)).otherwise(column)
    return column.cast("string")


def dictionary(values: DataFrame, folded: list[int]) -> DataFrame:
    """(field, raw, n, code): rows with each non-null value of each field, and an integer per
    canonical form. ``values``: field, raw; the fields in ``folded`` are canonicalised.

    All columns share one pass, one canonicalisation per distinct value and one numbering.
    """
    distinct = values.filter(F.col("raw").isNotNull()).groupBy("field", "raw").agg(F.count(F.lit(1)).alias("n"))
    fold_it = frozenset(folded)

    def once(field, raw, n):
        return [field, raw, n, [fold(r) if f in fold_it else r for f, r in zip(field, raw)]]

    forms = staged(distinct.mapInArrow(column_map(once, _FOLDED, 4096), "field int, raw string, n bigint, canon string"), "spelling_forms")
    codes = staged(forms.select("field", "canon").distinct().withColumn("code", F.monotonically_increasing_id() + 1), "spelling_codes")
    return staged(forms.join(codes, ["field", "canon"]).select("field", "raw", "n", "code"), "spelling_dictionary")


def encode(rows: DataFrame, row_id: str, fields: dict[str, bool], hot: int = HOT_GROUP) -> DataFrame:
    """(row_id, c0, c1, ...): each record as integers, in the order of the sorted field names.

    ``fields``: column to True where its spelling is folded, False where the text or
    number counts as it is. A dictionary whose size is known to be small is broadcast.
    Of a larger one only the entries in ``hot`` rows or more are (at most rows / ``hot``
    of them); their rows, and those that are null, take no part in the join by key but spread over it.
    """
    kinds = dict(rows.dtypes)
    names = sorted(fields)
    text = rows.select(F.col(row_id).cast("bigint").alias("_id"), *(_as_text(F.col(f"`{n}`"), kinds[n]).alias(f"_f{i}") for i, n in enumerate(names)))
    each = F.array(*(F.struct(F.lit(i).alias("field"), F.col(f"_f{i}").alias("raw")) for i in range(len(names))))
    books = dictionary(text.select(F.inline(each)), [i for i, n in enumerate(names) if fields[n]])
    sizes = {r["field"]: r for r in books.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("raw")).alias("chars"), F.max("n").alias("most")).collect()}
    for i in range(len(names)):
        book, size = books.filter(F.col("field") == i), sizes.get(i)
        own = F.concat(F.lit("\0"), F.col("_id").cast("string"))
        apart = text.withColumn(f"_f{i}", F.coalesce(f"_f{i}", own))  # null rows have no key in common
        entry = lambda b, code: b.select(F.col("raw").alias(f"_f{i}"), F.col("code").alias(code))  # noqa: E731, B023
        if size is None or (size["n"] <= BROADCAST_ROWS and (size["chars"] or 0) <= BROADCAST_CHARS):
            text = text.join(F.broadcast(entry(book, f"c{i}")), f"_f{i}", "left").drop(f"_f{i}")
        elif size["most"] >= hot:
            text = apart.join(F.broadcast(entry(book.filter(F.col("n") >= hot), "_hot")), f"_f{i}", "left")
            aside = F.when(F.col("_hot").isNull(), F.col(f"_f{i}")).otherwise(own)
            text = text.withColumn(f"_f{i}", aside).join(entry(book.filter(F.col("n") < hot), "_cold"), f"_f{i}", "left")
            text = text.withColumn(f"c{i}", F.coalesce("_hot", "_cold")).drop(f"_f{i}", "_hot", "_cold")
        else:
            text = apart.join(entry(book, f"c{i}"), f"_f{i}", "left").drop(f"_f{i}")
    return text.select("_id", *(F.coalesce(f"c{i}", F.lit(0)).alias(f"c{i}") for i in range(len(names))))


def groups(codes: DataFrame) -> DataFrame:
    """One row per tuple: the smallest row id and the number of copies."""
    tuple_ = [c for c in codes.columns if c != "_id"]
    return codes.groupBy(*tuple_).agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("copies"))


def collapse(rows: DataFrame, row_id: str, fields: dict[str, bool]) -> DataFrame:
    """(keep_id, copies): one row per record, whichever way it is written.

    Null matches null only; a text without letters and digits is an empty text.
    """
    return groups(staged(encode(rows, row_id, fields), "spelling_tuples")).select("keep_id", "copies")


def copies(rows: DataFrame, row_id: str, fields: dict[str, bool], hot: int = HOT_GROUP) -> DataFrame:
    """(keep_id, row_id) of every row that isn't the smallest of its group.

    Null matches null only; texts without letters and digits match each other and the empty
    text; 0 and -0 are one number. Texts count whole. A row id that occurs twice with the
    same record is one row. An empty table gives no rows; other columns are not read.

    Rows meet their group over the integer tuple. Groups of ``hot`` copies or more,
    of which there are at most rows / ``hot``, spread over ``SALTS`` join keys.
    """
    codes = staged(encode(rows, row_id, fields, hot), "spelling_tuples")
    tuple_ = [c for c in codes.columns if c != "_id"]
    found = staged(groups(codes).filter("copies > 1"), "spelling_groups")
    large = found.filter(F.col("copies") >= hot).select(*tuple_, F.lit(True).alias("_hot"))
    none = large.limit(1).count() == 0
    if none:
        left, right, keys = codes, found, tuple_
    else:
        salt = F.when(F.col("_hot"), F.pmod(F.xxhash64("_id"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
        left = codes.join(F.broadcast(large), tuple_, "left").withColumn("_salt", salt).drop("_hot")
        salts = F.when(F.col("copies") >= hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        right, keys = found.withColumn("_salt", F.explode(salts)), [*tuple_, "_salt"]
    return left.join(right, keys).filter(F.col("_id") != F.col("keep_id")).select("keep_id", F.col("_id").alias("row_id"))


#: The two listings of the data: which fields make a record, and which of them are folded.
LISTINGS = {
    "juice_shop_products": {"name": True, "brand": True, "price": False},
    "streaming_clone_catalog": {"title": True, "category": True, "poster": False},
}
