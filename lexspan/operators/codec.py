"""Encoding and decoding of columns: split in the JVM, merges in Arrow batches over a broadcast vocabulary."""

from __future__ import annotations

import codecs
import os
from collections.abc import Collection
from collections.abc import Set as AbstractSet
from functools import reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..encoding import ALL, Encoding
from ..functions import text as T
from ..functions.bpe import decoder, encode_lists, merger
from ..sources.ranks import framed_files, text_files
from . import chat

ROOT = str(Path(__file__).resolve().parents[2])


def workers(spark: SparkSession) -> None:
    """Lets Python workers import this package."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


class Codec:
    """An Encoding's columns in one Spark session. The vocabulary is broadcast once (a few MB, fixed by the encoding)."""

    def __init__(self, spark: SparkSession, enc: Encoding):
        workers(spark)
        self.spark, self.enc = spark, enc
        held, key, cap = spark.sparkContext.broadcast(enc._mergeable_ranks), enc.key, enc._cap
        table = spark.sparkContext.broadcast(enc.decoder)
        own = f"{key} {sorted(enc._special_tokens.items())}"

        @arrow_udf("array<int>")
        def ids(p: pa.Array) -> pa.Array:
            return encode_lists(p, merger(key, held.value, cap))

        @arrow_udf("int")
        def number(p: pa.Array) -> pa.Array:
            return encode_lists(p, merger(key, held.value, cap), count_only=True)

        @arrow_udf("array<int>")
        def mixed(p: pa.Array, s: pa.Array) -> pa.Array:
            return encode_lists(p, merger(key, held.value, cap), s)

        def lists(p: pa.Array) -> pa.ListArray:
            p = p.combine_chunks() if isinstance(p, pa.ChunkedArray) else p
            flat = p.flatten()
            one = pa.ListArray.from_arrays(pa.array(range(len(flat) + 1), pa.int32()), flat)
            ends = pa.compute.cumulative_sum(pa.concat_arrays([pa.array([0], pa.int32()), p.value_lengths().fill_null(0)]))
            return pa.ListArray.from_arrays(ends, encode_lists(one, merger(key, held.value, cap)), mask=p.is_null() if p.null_count else None)

        @arrow_udf("array<array<int>>")
        def each(p: pa.Array) -> pa.Array:
            return lists(p)

        @arrow_udf("struct<ids:array<int>,token_offsets:array<int>>")
        def flat(p: pa.Array) -> pa.Array:
            got = lists(p)
            sizes = got.flatten().value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            cuts = np.concatenate(([0], np.cumsum(got.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int64)
            total = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
            ids = pa.ListArray.from_arrays(pa.array(total[cuts].astype(np.int32)), got.flatten().flatten())
            # of each row the ends of its ranges, from its own beginning, with a 0 before them
            where = np.arange(len(total) - 1 + len(got)) - np.repeat(np.arange(len(got)), np.diff(cuts) + 1)
            begin = np.repeat(total[cuts[:-1]], np.diff(cuts) + 1)
            offs = pa.ListArray.from_arrays(pa.array((cuts + np.arange(len(cuts))).astype(np.int32)), pa.array((total[where] - begin).astype(np.int32)))
            return pa.StructArray.from_arrays([ids, offs], ["ids", "token_offsets"], mask=got.is_null() if got.null_count else None)

        @arrow_udf("binary")
        def to_bytes(i: pa.Array) -> pa.Array:
            return decoder(own, table.value).bytes_of(i)

        @arrow_udf("array<int>")
        def offsets(i: pa.Array) -> pa.Array:
            return decoder(own, table.value).offsets_of(i)

        @arrow_udf("array<binary>")
        def token_bytes(i: pa.Array) -> pa.Array:
            return pa.array([None if x is None else [table.value[t] for t in x] for x in i.to_pylist()], pa.list_(pa.binary()))

        @arrow_udf("string")
        def ignoring(i: pa.Array) -> pa.Array:
            got = decoder(own, table.value).bytes_of(i)
            return pa.array([None if b is None else b.decode("utf-8", "ignore") for b in got.to_pylist()], pa.string())

        @arrow_udf("array<string>")
        def stream(i: pa.Array) -> pa.Array:
            def parts(x: list[int]) -> list[str]:
                d = codecs.getincrementaldecoder("utf-8")("replace")
                return [s for s in (*(d.decode(table.value[t]) for t in x), d.decode(b"", True)) if s]

            return pa.array([None if x is None else parts(x) for x in i.to_pylist()], pa.list_(pa.string()))

        @arrow_udf("array<int>")
        def stitch(ids: pa.Array, chunks: pa.Array, starts: pa.Array, size: pa.Array) -> pa.Array:
            """Of each chunk's tokens those that begin in it; the last chunk also owns what lies behind it."""

            def one(ids: list[list[int]], chunks: list[int], starts: list[int], size: int) -> list[int]:
                out = []
                for x, c, at in zip(ids, chunks, starts, strict=True):
                    for t in x:
                        if min(at // size, len(chunks) - 1) == c:
                            out.append(t)
                        at += len(table.value[t])
                return out

            rows = zip(ids.to_pylist(), chunks.to_pylist(), starts.to_pylist(), size.to_pylist(), strict=True)
            return pa.array([None if x is None else one(x, c, s, n) for x, c, s, n in rows], pa.list_(pa.int32()))

        self.stitch = stitch
        self._ids, self._number, self._mixed, self._each, self._flat = ids, number, mixed, each, flat
        self._bytes, self._offsets, self._token_bytes, self._ignoring, self._stream = to_bytes, offsets, token_bytes, ignoring, stream

    # encode
    def pieces(self, text: Column) -> Column:
        return T.pieces(text, self.enc._pat_str)

    def encode_ordinary(self, text: Column) -> Column:
        return self._ids(self.pieces(text))

    def encode_pieces(self, pieces: Column) -> Column:
        return self._ids(pieces)

    def encode_bytes(self, data: Column) -> Column:
        """Raw bytes as one piece, without the split pattern (empty: no ids)."""
        return self._ids(F.when(data.isNotNull(), F.filter(F.array(data), lambda x: F.octet_length(x) > 0)))

    def count_bytes(self, data: Column) -> Column:
        return self._number(F.when(data.isNotNull(), F.filter(F.array(data), lambda x: F.octet_length(x) > 0)))

    def _checked(self, text: Column, allowed: set[str], disallowed: str | Collection[str], on: str) -> Column:
        banned = [s for s in ((self.enc.special_tokens_set if disallowed == ALL else set(disallowed)) - allowed) if s]
        if on not in ("raise", "null"):
            raise ValueError("on_disallowed is 'raise' or 'null'")
        if not banned:
            return text
        found = F.lit(False)
        for s in banned:
            found = found | F.contains(text, F.lit(s))
        return F.when(found, F.raise_error(F.lit("the text holds a special token that isn't allowed")).cast("string") if on == "raise" else F.lit(None).cast("string")).otherwise(text)

    def _parts(self, text: Column, allowed_special: str | AbstractSet[str], disallowed_special: str | Collection[str], on_disallowed: str) -> tuple[Column, Column | None]:
        """Pieces, and beside them the ids of those that are special tokens. The text is split at these first."""
        allowed = self.enc._allowed(allowed_special)
        text = self._checked(text, allowed, disallowed_special, on_disallowed)
        if not allowed:
            return self.pieces(text), None
        known = {s: i for s, i in self.enc._special_tokens.items() if s in allowed}
        if allowed - set(known):
            raise KeyError(f"not special tokens of {self.enc.name}: {sorted(allowed - set(known))}")
        both = self._interleaved(text, known)
        return F.transform(both, lambda x: x["p"]), F.transform(both, lambda x: x["s"])

    def _interleaved(self, text: Column, known: dict[str, int]) -> Column:
        """Pieces and special tokens of a text, in order: structs of p, and s (the id of a special token)."""
        gaps, specials = T.split_specials(text, list(known))
        id_of = F.create_map(*(x for s, i in known.items() for x in (F.lit(s), F.lit(i))))
        none = F.lit(None).cast("int")
        pair = lambda p, s: F.named_struct(F.lit("p"), p, F.lit("s"), s)
        plain = F.transform(gaps, lambda g: F.transform(self.pieces(g), lambda p: pair(p, none)))
        marks = F.transform(specials, lambda s: F.array(pair(s, F.element_at(id_of, s))))
        empty = F.array().cast("array<struct<p:string,s:int>>")
        return F.flatten(F.zip_with(plain, marks, lambda a, m: F.concat(a, F.coalesce(m, empty))))

    def encode(self, text: Column, allowed_special: str | AbstractSet[str] = frozenset(), disallowed_special: str | Collection[str] = ALL, on_disallowed: str = "raise") -> Column:
        p, s = self._parts(text, allowed_special, disallowed_special, on_disallowed)
        return self._ids(p) if s is None else self._mixed(p, s)

    def count(self, text: Column, **policy) -> Column:
        p, s = self._parts(text, policy.get("allowed_special", frozenset()), policy.get("disallowed_special", ALL), policy.get("on_disallowed", "raise"))
        return self._number(p) if s is None else F.size(self._mixed(p, s))

    def count_by(self, df: DataFrame, text_col: str, by: list[str]) -> DataFrame:
        """(by, n_rows, n_tokens): sums of encode_ordinary's counts by group. Pieces are counted first, and each distinct one merged once."""
        text = F.col(text_col)
        pieces = df.select(*by, F.explode(self.pieces(text)).alias("_p")).groupBy(*by, "_p").agg(F.count("*").alias("_n"))
        tokens = pieces.select(*by, (F.col("_n") * self._number(F.array("_p"))).alias("_k")).groupBy(*by).agg(F.sum("_k").alias("n_tokens"))
        rows = df.groupBy(*by).agg(F.count("*").alias("n_rows"))
        same = [rows[c].eqNullSafe(tokens[c]) for c in by]
        return rows.join(tokens, same, "left").select(*(rows[c] for c in by), "n_rows", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))

    def within_limit(self, text: Column, limit: int, **policy) -> Column:
        """The count where it is at most limit, else null."""
        if limit < 0:
            raise ValueError("a token limit can't be negative")
        n = self.count(text, **policy)
        return F.when(n <= limit, n)

    def encode_generator(self, df: DataFrame, text_col: str, allowed_special: str | AbstractSet[str] = frozenset(), disallowed_special: str | Collection[str] = ALL, on_disallowed: str = "raise") -> DataFrame:
        """df's other columns with (pos, piece, ids): a row for each piece; with allowed special tokens, one for each text between them and
        one for each of them."""
        keep = [c for c in df.columns if c != text_col]
        allowed = self.enc._allowed(allowed_special)
        text = self._checked(F.col(text_col), allowed, disallowed_special, on_disallowed)
        if not allowed:
            p = df.select(*keep, self.pieces(text).alias("_p")).withColumn("_i", self._each(F.col("_p")))
            both = F.zip_with("_p", "_i", lambda p, i: F.named_struct(F.lit("piece"), p, F.lit("ids"), i))
            return p.select(*keep, F.posexplode(both).alias("pos", "_x")).select(*keep, "pos", "_x.piece", "_x.ids")
        known = {s: i for s, i in self.enc._special_tokens.items() if s in allowed}
        gaps, specials = T.split_specials(text, list(known))
        pair = lambda t, special: F.named_struct(F.lit("t"), t, F.lit("special"), F.lit(special))
        parts = F.zip_with(gaps, specials, lambda g, m: F.filter(F.array(F.when(g != "", pair(g, False)), F.when(m.isNotNull(), pair(m, True))), lambda x: x.isNotNull()))
        rows = df.select(*keep, F.posexplode(F.flatten(parts)).alias("pos", "_x")).select(*keep, "pos", F.col("_x.t").alias("piece"), "_x.special")
        id_of = F.create_map(*(x for s, i in known.items() for x in (F.lit(s), F.lit(i))))
        ids = F.when(F.col("special"), F.array(F.element_at(id_of, F.col("piece")))).otherwise(self.encode_ordinary(F.when(~F.col("special"), F.col("piece"))))
        return rows.select(*keep, "pos", "piece", ids.alias("ids"))

    def encode_ranges(self, data: Column, ranges: Column) -> Column:
        """Raw merges of each (start, end) byte range; ranges may overlap, and must lie inside the data."""
        return self._each(self._slices(data, ranges))

    @staticmethod
    def _slices(data: Column, ranges: Column) -> Column:
        bad = F.exists(ranges, lambda r: (r["start"] < 0) | (r["end"] < r["start"]) | (r["end"] > F.octet_length(data)))
        part = F.transform(ranges, lambda r: F.substring(data, r["start"] + 1, r["end"] - r["start"]))
        return F.when(bad, F.raise_error(F.lit("a byte range outside the data")).cast("array<binary>")).otherwise(part)

    def encode_ranges_flat(self, data: Column, ranges: Column) -> Column:
        """(ids, token_offsets): the ids of all ranges in a row, and where each range's begin, and the end."""
        return self._flat(self._slices(data, ranges))

    def encode_files(self, path: str, framed: bool = True, **policy) -> DataFrame:
        """(path, ids) of whole files: split by the pattern, or (framed=False) as raw bytes without it."""
        if not framed:
            return text_files(self.spark, path).select("path", self.encode_bytes(F.col("content")).alias("ids"))
        return framed_files(self.spark, path).select("path", self.encode(F.col("text"), **policy).alias("ids"))

    def count_files(self, path: str, limit: int | None = None, framed: bool = True, **policy) -> DataFrame:
        """(path, n_tokens) of whole files; with a limit, null beyond it."""
        if limit is not None and limit < 0:
            raise ValueError("a token limit can't be negative")
        if framed:
            rows = framed_files(self.spark, path).select("path", self.count(F.col("text"), **policy).alias("n"))
        else:
            rows = text_files(self.spark, path).select("path", self.count_bytes(F.col("content")).alias("n"))
        return rows.select("path", (F.col("n") if limit is None else F.when(F.col("n") <= limit, F.col("n"))).alias("n_tokens"))

    def vocabulary(self) -> DataFrame:
        rows = [(bytearray(t), r, False) for t, r in self.enc._mergeable_ranks.items()] + [(bytearray(s.encode()), i, True) for s, i in self.enc._special_tokens.items()]
        return self.spark.createDataFrame(rows, "token binary, id int, is_special boolean")

    def single_tokens(self, df: DataFrame, col: str) -> DataFrame:
        """df with token_id: the id of the token that the whole value is, or null. The vocabulary's size is fixed: it is broadcast."""
        v = self.vocabulary().groupBy("token").agg(F.max_by("id", "is_special").alias("token_id"))
        return df.withColumn("_t", F.col(col).cast("binary")).join(F.broadcast(v), F.col("_t") == F.col("token"), "left").drop("_t", "token")

    def single_token_bytes(self, df: DataFrame, col: str, on_unknown: str = "null") -> DataFrame:
        """df with token_bytes: the bytes of the token whose id the value is; unknown ids give null, or fail (on_unknown="raise")."""
        if on_unknown not in ("raise", "null"):
            raise ValueError("on_unknown is 'raise' or 'null'")
        v = self.vocabulary().groupBy("id").agg(F.max_by("token", "is_special").alias("_t"))
        found = df.withColumn("_id", F.col(col).cast("int")).join(F.broadcast(v.withColumnRenamed("id", "_v")), F.col("_id") == F.col("_v"), "left").drop("_id", "_v")
        t = F.col("_t")
        if on_unknown == "raise":
            t = F.when(t.isNull() & F.col(col).isNotNull(), F.raise_error(F.lit("an id that the vocabulary doesn't have")).cast("binary")).otherwise(t)
        return found.withColumn("token_bytes", t).drop("_t")

    # decode
    def decode_bytes(self, ids: Column) -> Column:
        return self._bytes(ids)

    def decode(self, ids: Column, errors: str = "replace") -> Column:
        if errors == "ignore":
            return self._ignoring(ids)
        s = self._bytes(ids).cast("string")
        return F.make_valid_utf8(s) if errors == "replace" else F.validate_utf8(s)

    def decode_tokens_bytes(self, ids: Column) -> Column:
        return self._token_bytes(ids)

    def decode_with_offsets(self, ids: Column) -> Column:
        return F.struct(self.decode(ids, "strict").alias("text"), self._offsets(ids).alias("offsets"))

    def decode_generator(self, ids: Column) -> Column:
        return self._stream(ids)

    # chat
    def _segment_parts(self, segments: Column, template, allowed_special, disallowed_special, on_disallowed: str) -> tuple[Column, Column | None]:
        """Pieces of segments, each split on its own. Special tokens that the template writes are allowed, as in the scalar form."""
        allowed = self.enc._allowed(allowed_special) | chat.implied_specials(chat.resolve_template(template), self.enc._special_tokens)
        banned = [s for s in ((self.enc.special_tokens_set if disallowed_special == ALL else set(disallowed_special)) - allowed) if s]
        whole = segments
        if banned:  # checked over all segments, before they are split
            bad = F.exists(segments, lambda s: reduce(lambda a, b: a | b, (F.contains(s, F.lit(x)) for x in banned)))
            other = F.raise_error(F.lit("a segment holds a special token that isn't allowed")) if on_disallowed == "raise" else F.lit(None)
            whole = F.when(bad, other.cast("array<string>")).otherwise(segments)
        if not allowed:
            return F.flatten(F.transform(whole, lambda s: self.pieces(s))), None
        known = {s: i for s, i in self.enc._special_tokens.items() if s in allowed}
        both = F.flatten(F.transform(whole, lambda s: self._interleaved(s, known)))
        return F.transform(both, lambda x: x["p"]), F.transform(both, lambda x: x["s"])

    def encode_segments(self, segments: Column, template=None, allowed_special: str | AbstractSet[str] = frozenset(), disallowed_special: str | Collection[str] = ALL, on_disallowed: str = "raise") -> Column:
        """The ids of a conversation's segments in a row, each segment split on its own, under the special-token policy."""
        p, s = self._segment_parts(segments, template, allowed_special, disallowed_special, on_disallowed)
        return self._ids(p) if s is None else self._mixed(p, s)

    def count_segments(self, segments: Column, template=None, allowed_special: str | AbstractSet[str] = frozenset(), disallowed_special: str | Collection[str] = ALL, on_disallowed: str = "raise") -> Column:
        p, s = self._segment_parts(segments, template, allowed_special, disallowed_special, on_disallowed)
        return self._number(p) if s is None else F.size(self._mixed(p, s))

    def register(self, prefix: str = "") -> None:
        """SQL functions over pieces and ids: <prefix>encode_pieces, <prefix>count_pieces, <prefix>decode_bytes."""
        for name, f in (("encode_pieces", self._ids), ("count_pieces", self._number), ("decode_bytes", self._bytes)):
            self.spark.udf.register(prefix + name, f)
