"""Secrets out of shared output, as chained built-in replacements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REDACTED = "[REDACTED]"

#: Secret shapes in the order they are applied; group 1 is kept.
RULES = (
    (r"(?iU)\b(bearer\s+)[\w.~+/=-]{8,}", "$1[REDACTED]"),
    (r"(?iU)((?:proxy-)?authorization:\s*basic\s+)[A-Za-z0-9+/=]{8,}", "$1[REDACTED]"),
    (
        r"(?iU)\b((?:session(?:id)?|sessid|sid|auth[_-]?token|access[_-]?token|refresh[_-]?token|id[_-]?token|csrf[_-]?token"
        r"|xsrf[_-]?token|token|phpsessid|jsessionid|connect\.sid|api[_-]?key|apikey|client[_-]?secret|api[_-]?secret|password|passwd|pwd)=)[^\s;,]+",
        "$1[REDACTED]",
    ),
    (r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", REDACTED),
    (r"(?U)\beyJ[\w-]+\.eyJ[\w-]+\.[\w-]+", REDACTED),
    (r"(?U)\bsk-[A-Za-z0-9][A-Za-z0-9_-]{15,}", REDACTED),
    (r"(?U)\b[sr]k_(?:live|test)_[A-Za-z0-9]{16,}\b", REDACTED),
    (r"(?U)\bGOCSPX-[A-Za-z0-9_-]{16,}", REDACTED),
    (r"(?U)\bAKIA[0-9A-Z]{16}\b", REDACTED),
    (r"(?U)\bAIza[0-9A-Za-z_-]{35}\b", REDACTED),
    (r"(?U)\bgh[pousr]_[A-Za-z0-9]{36,}\b", REDACTED),
    (r"(?U)\bgithub_pat_[A-Za-z0-9_]{20,}\b", REDACTED),
    (r"(?U)\bxox[baprs]-[A-Za-z0-9-]{10,}", REDACTED),
)


def redact(text: Column) -> Column:
    """Every recognised secret replaced; a kept prefix names what it was. Idempotent."""
    return reduce(lambda c, rule: F.regexp_replace(c, *rule), RULES, text)


def redact_typed(column: Column, kind: T.DataType) -> Column:
    """All strings inside a column of any type redacted; keys and shape stay."""
    if isinstance(kind, T.StringType):
        return redact(column)
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: redact_typed(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(column, lambda _, v: redact_typed(v, kind.valueType))
    if isinstance(kind, T.StructType):
        fields = F.struct(*(redact_typed(column[f.name], f.dataType).alias(f.name) for f in kind))
        return F.when(column.isNotNull(), fields)
    return column


def redact_frame(df: DataFrame) -> DataFrame:
    """Every string of every column redacted, nested ones too."""
    return df.select(*(redact_typed(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema))
