"""SQL functions for a session."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..encoding import Encoding, get_encoding
from ..operators.codec import Codec, workers


def register(spark: SparkSession, names: tuple[str, ...] = ("r50k_base",)) -> None:
    """Registers <encoding>_encode_pieces, <encoding>_count_pieces and <encoding>_decode_bytes, for encodings whose rank file is here."""
    for name in names:
        Codec(spark, get_encoding(name)).register(f"{name}_")


def register_generators(spark: SparkSession, enc: Encoding, prefix: str) -> None:
    """Table functions for LATERAL joins: <prefix>encode_generator(text) gives (pos, piece, ids), a row for each piece, and
    <prefix>decode_generator(ids) gives (pos, part), the text as its ids complete it. Null gives no rows."""
    workers(spark)
    name, pattern, ranks, specials = enc.name, enc._pat_str, enc._mergeable_ranks, enc._special_tokens

    class Own:
        def __init__(self) -> None:
            self.enc = Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens=specials)

    @udtf(returnType="pos int, piece string, ids array<int>")
    class EncodeGenerator(Own):
        def eval(self, text: str) -> Iterator[tuple]:
            if text is not None:
                for i, p in enumerate(self.enc._pieces(text)):
                    yield i, p.decode(), list(self.enc.merger.piece(p))

    @udtf(returnType="pos int, part string")
    class DecodeGenerator(Own):
        def eval(self, ids: list) -> Iterator[tuple]:
            if ids is not None:
                yield from enumerate(self.enc.decode_generator(ids))

    spark.udtf.register(f"{prefix}encode_generator", EncodeGenerator)
    spark.udtf.register(f"{prefix}decode_generator", DecodeGenerator)


def split_sql(text: str, pattern: str) -> str:
    """The SQL expression of the pieces of a text expression."""
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    return f"filter(regexp_extract_all({text}, '(?U)(?:{quoted})', 0), x -> x <> '')"
