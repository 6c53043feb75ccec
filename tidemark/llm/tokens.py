"""Token counts of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def byte_tokens(text: Column) -> Column:
    """Tokens of the ByT5 byte tokenizer without special tokens: one per UTF-8 byte; null is none."""
    return F.coalesce(F.octet_length(text.cast("string")), F.lit(0)).cast("bigint")


def with_tokens(df: DataFrame, text: str = "text", tokenizer: str | None = None, out: str = "n_tokens") -> DataFrame:
    """``df`` with a token count. ``tokenizer``: path of a ``tokenizers`` JSON file all executors
    can read; None for the byte tokenizer, which needs no Python."""
    if tokenizer is None:
        return df.withColumn(out, byte_tokens(F.col(text)))

    @F.pandas_udf("bigint")
    def count(texts):
        import pandas as pd
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer)
        t.encode_special_tokens = True
        sizes = [len(e.ids) for e in t.encode_batch(texts.fillna("").tolist(), add_special_tokens=False)]
        return pd.Series(sizes)

    return df.withColumn(out, count(F.col(text).cast("string")))


