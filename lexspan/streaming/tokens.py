"""The row-wise operations on streams: they are the column forms, unchanged. Token budgets by time window add a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.codec import Codec


def with_tokens(stream: DataFrame, codec: Codec, text_col: str, ids: bool = False) -> DataFrame:
    """stream with n_tokens (and ids)."""
    out = stream.withColumn("n_tokens", codec.count(F.col(text_col), on_disallowed="null"))
    return out.withColumn("ids", codec.encode(F.col(text_col), on_disallowed="null")) if ids else out


def windowed_tokens(stream: DataFrame, codec: Codec, text_col: str, time_col: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    counted = with_tokens(stream.withWatermark(time_col, late), codec, text_col)
    return counted.groupBy(F.window(time_col, width)).agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_rows"))
