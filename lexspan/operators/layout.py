"""Where tokens lie: byte ranges, chunks, owners and stitched encoding. Built-in functions only, but for the merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def valid_ranges(ranges: Column, length: Column) -> Column:
    return F.forall(ranges, lambda r: (r["start"] >= 0) & (r["start"] <= r["end"]) & (r["end"] <= length))


def token_layout(tokens: DataFrame, lengths: DataFrame, chunk_bytes: int, n_chunks: int, source_chunk_base: int = 0) -> DataFrame:
    """tokens: (range_id, start, pos, id), lengths: (id, n). Adds token_start (global byte), source_chunk (base + number of the range) and
    owned (does the token start in its source chunk)."""
    if chunk_bytes <= 0 or n_chunks <= 0:
        raise ValueError("chunk_bytes and n_chunks must be positive")
    w = Window.partitionBy("range_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    t = tokens.join(lengths, "id").withColumn("token_start", F.col("start") + F.coalesce(F.sum("n").over(w), F.lit(0)))
    t = t.withColumn("source_chunk", (F.col("range_id") + source_chunk_base).cast("int"))
    return t.withColumn("owned", owner(F.col("token_start"), chunk_bytes, n_chunks) == F.col("source_chunk"))


def owner(start: Column, chunk_bytes: int, n_chunks: Column | int) -> Column:
    """The chunk that a byte belongs to; the last takes what lies behind it."""
    last = (F.lit(n_chunks) if isinstance(n_chunks, int) else n_chunks) - 1
    return F.least(F.floor(start / chunk_bytes).cast("int"), last.cast("int"))


def keep_flagged(tokens: Column, flags: Column) -> Column:
    """The tokens whose flag isn't 0. Lists of unlike length fail."""
    got = F.transform(F.filter(F.zip_with(tokens, flags, lambda t, f: F.named_struct(F.lit("t"), t, F.lit("f"), f)), lambda x: x["f"] != 0), lambda x: x["t"])
    return F.when(F.size(tokens) != F.size(flags), F.raise_error(F.lit("tokens and flags of unlike length")).cast("array<int>")).otherwise(got)


def chunk_ranges(length: Column, chunk_bytes: int, overlap_bytes: int) -> Column:
    """(chunk, start, end): the byte range that each chunk encodes, with its overlap to both sides."""
    n = F.ceil(length / chunk_bytes).cast("int")
    one = lambda c: F.struct(c.alias("chunk"), F.greatest(F.lit(0), c * chunk_bytes - overlap_bytes).alias("start"), F.least(length, (c + 1) * chunk_bytes + overlap_bytes).alias("end"))
    return F.when(length > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), one)).otherwise(F.array().cast("array<struct<chunk:int,start:int,end:int>>"))


def encode_stitched(codec, df: DataFrame, data_col: str, chunk_bytes: int = 16384, overlap_bytes: int = 512) -> DataFrame:
    """df with stitched: ids of overlapping chunks, each token kept by the chunk it starts in. Approximate: exact where chunks fall in step again."""
    if chunk_bytes <= 0 or overlap_bytes < 0:
        raise ValueError("chunk_bytes must be positive, and overlap_bytes not negative")
    data = F.col(data_col).cast("binary")
    d = df.withColumn("_r", chunk_ranges(F.octet_length(data), chunk_bytes, overlap_bytes))
    d = d.withColumn("_ids", codec.encode_ranges(data, F.col("_r")))
    return d.withColumn("stitched", codec.stitch(F.col("_ids"), F.col("_r.chunk"), F.col("_r.start"), F.lit(chunk_bytes))).drop("_r", "_ids")
