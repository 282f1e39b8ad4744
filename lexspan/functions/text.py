"""Splitting texts and counting bytes, in built-in functions (but for a running sum)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  # pa.compute
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf


def pieces(text: Column, pattern: str) -> Column:
    """The pieces a split pattern finds, as Unicode has it ((?U)); what it doesn't match is left out, as are empty matches."""
    return F.filter(F.regexp_extract_all(text, F.lit(f"(?U)(?:{pattern})"), F.lit(0)), lambda x: x != "")


def letter_space_pieces(text: Column) -> Column:
    """Words with one leading space, other spaces on their own; null where anything but A-Z, a-z and space occurs."""
    got = F.regexp_extract_all(text, F.lit(r"[ ]+(?=[ ][A-Za-z])|[ ]?[A-Za-z]+|[ ]+"), F.lit(0))
    return F.when(text.rlike(r"\A[A-Za-z ]*\z"), got)


def _ranges(pieces_: pa.Array) -> pa.Array:
    """A running sum over lists of pieces: built-in array functions would take quadratic time."""
    pieces_ = pieces_.combine_chunks() if isinstance(pieces_, pa.ChunkedArray) else pieces_
    sizes = pa.compute.binary_length(pieces_.flatten()).to_numpy(zero_copy_only=False).astype(np.int64)
    offs = np.concatenate(([0], np.cumsum(pieces_.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))))
    total = np.concatenate(([0], np.cumsum(sizes)))
    base = np.repeat(total[offs[:-1]], np.diff(offs))
    both = pa.StructArray.from_arrays([pa.array((total[:-1] - base).astype(np.int32)), pa.array((total[1:] - base).astype(np.int32))], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), both, mask=pieces_.is_null() if pieces_.null_count else None)


def piece_ranges(pieces_: Column) -> Column:
    """(start, end) byte ranges of pieces laid end to end."""
    return arrow_udf(_ranges, "array<struct<start:int,end:int>>")(pieces_)


def split_specials(text: Column, specials: list[str]) -> tuple[Column, Column]:
    """(gaps, specials between them); of specials that begin at one place the longest is taken."""
    rx = "|".join("\\Q" + s + "\\E" for s in sorted(specials, key=len, reverse=True))
    return F.split(text, rx, -1), F.regexp_extract_all(text, F.lit(rx), F.lit(0))


def byte_values(data: Column) -> Column:
    """The bytes of a binary column as numbers (UTF-8 byte encoding)."""
    n = F.octet_length(data)
    each = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("int"))
    return F.when(n > 0, each).when(n == 0, F.array().cast("array<int>"))


def bytes_from_values(values: Column) -> Column:
    """Numbers 0 to 255 as bytes; others fail."""
    bad = F.exists(values, lambda x: (x < 0) | (x > 255) | x.isNull())
    return F.when(bad, F.raise_error(F.lit("a value that is no byte")).cast("binary")).otherwise(F.unhex(F.array_join(F.transform(values, lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")), "")))


def byte_length(text: Column) -> Column:
    return F.octet_length(text)


def _hex(data: Column) -> Column:
    return F.hex(data.cast("binary"))


def non_ascii_bytes(text: Column) -> Column:
    """Bytes of 0x80 or more: two hexadecimal digits, the first from 8 on."""
    low = F.regexp_replace(_hex(text), "([0-7].)|(?:[89A-F].)", "$1")
    return F.octet_length(text) - (F.length(low) / 2).cast("int")


def nonzero_bytes(data: Column) -> Column:
    return (F.length(F.regexp_replace(_hex(data), "(?:00)|(..)", "$1")) / 2).cast("int")


def class_boundaries(text: Column) -> Column:
    """Neighbouring bytes of unlike class: space, letter, digit, other printable ASCII, the rest."""
    b = byte_values(text.cast("binary"))

    def kind(x: Column) -> Column:
        return F.when(x == 32, 0).when(((x >= 65) & (x <= 90)) | ((x >= 97) & (x <= 122)), 1).when((x >= 48) & (x <= 57), 2).when((x >= 33) & (x <= 126), 3).otherwise(4)

    k = F.transform(b, kind)
    n = F.size(k)
    pairs = F.zip_with(F.slice(k, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(k, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda x, y: (x != y).cast("int"))
    return F.when(n >= 0, F.aggregate(pairs, F.lit(0), lambda a, x: a + x))


def token_bound(text: Column) -> Column:
    """A rough number of tokens: bytes over four, rounded up."""
    return F.ceil(F.octet_length(text) / 4).cast("int")


def low_entropy(data: Column, least: int = 65_536, kinds: int = 4, share: float = 0.98) -> Column:
    """Long, and its first 64 KiB hold few byte values, one of them nearly everywhere."""
    head = F.substring(data, F.lit(1), F.lit(65_536))
    v = byte_values(head)
    top = F.array_max(F.transform(F.array_distinct(v), lambda x: F.size(F.filter(v, lambda y: y == x))))
    return (F.octet_length(data) >= least) & (F.size(F.array_distinct(v)) <= kinds) & (top >= share * F.size(v))
