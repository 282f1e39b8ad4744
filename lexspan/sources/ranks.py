"""Vocabulary files: text rank files (base64, space, rank), binary rank blobs, and where they lie."""

from __future__ import annotations

import base64
import binascii
import hashlib
import os
import struct
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the binary blob's header and its mark of a missing rank
MAGIC, HEADER, MISSING = b"TTKRBIN1", struct.Struct("<8sIIQQII"), 0xFFFFFFFF
VERSION, FLAGS = 1, 0
#: local vocabularies that stand in where a rank file is named by one of these
LOCAL = {"r50k_base": "byte_bpe_50k.tiktoken"}


def cache_dir() -> Path:
    return Path(os.environ.get("LEXSPAN_CACHE_DIR") or Path.home() / ".cache" / "lexspan")


def rank_file_path(name: str, cache: str | Path | None = None, tokenizers: str | Path = "/opt/tokenizers") -> Path:
    """Where the rank file of an encoding lies: in the cache, else among the public tokenizers."""
    at = Path(cache or cache_dir()) / f"{name}.tiktoken"
    if not at.exists() and name in LOCAL and (own := Path(tokenizers) / LOCAL[name]).exists():
        return own
    return at


def read_rank_file(name: str, cache: str | Path | None = None) -> bytes:
    path = rank_file_path(name, cache)
    if not path.exists():
        raise FileNotFoundError(f"no rank file for {name}: put it at {path} (nothing is downloaded)")
    return path.read_bytes()


def parse_ranks(payload: bytes, strict: bool = False) -> dict[bytes, int]:
    """token -> rank. Blank lines are skipped; the last of repeated tokens counts, or with strict anything odd is an error."""
    out: dict[bytes, int] = {}
    seen: set[int] = set()
    for i, line in enumerate(payload.splitlines(), 1):
        parts = line.split()
        if not parts:
            continue
        try:
            token, rank = base64.b64decode(parts[0], validate=strict), int(parts[1])
        except (IndexError, ValueError, binascii.Error) as e:
            raise ValueError(f"line {i} isn't a base64 token and a rank") from e
        if strict and (len(parts) != 2 or not 0 <= rank < 2**32 or token in out or rank in seen):
            raise ValueError(f"line {i}: a repeated or odd token or rank")
        out[token] = rank
        seen.add(rank)
    return out


def parse_blob(payload: bytes, strict: bool = False) -> dict[bytes, int]:
    """token -> rank of a binary blob; with strict, what follows the last rank is an error."""
    if len(payload) < HEADER.size:
        raise ValueError("the blob is shorter than its header")
    magic, version, flags, _, _, entries, ranks = HEADER.unpack_from(payload)
    if (magic, version, flags) != (MAGIC, VERSION, FLAGS):
        raise ValueError("not a rank blob of a known version")
    out, at = {}, HEADER.size
    for rank in range(ranks):
        if at + 4 > len(payload):
            raise ValueError("the blob breaks off")
        (n,) = struct.unpack_from("<I", payload, at)
        at += 4
        if n != MISSING:
            if at + n > len(payload):
                raise ValueError("the blob breaks off")
            out[payload[at : at + n]] = rank
            at += n
    if len(out) != entries:
        raise ValueError("the blob's number of entries is wrong")
    if strict and at != len(payload):
        raise ValueError("the blob goes on behind its last rank")
    return out


def write_blob(ranks: dict[bytes, int], source_size: int = 0, source_mtime: int = 0) -> bytes:
    by_rank = {r: t for t, r in ranks.items()}
    if len(by_rank) != len(ranks):
        raise ValueError("two tokens have one rank")
    top = max(by_rank, default=-1) + 1
    body = b"".join(struct.pack("<I", len(by_rank[r])) + by_rank[r] if r in by_rank else struct.pack("<I", MISSING) for r in range(top))
    return HEADER.pack(MAGIC, VERSION, FLAGS, source_size, source_mtime, len(ranks), top) + body


def file_sha256(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def scan_ranks(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(token binary, rank int) of a text rank file; repeated tokens keep the last rank, or fail with strict."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p"), F.monotonically_increasing_id().alias("i")).where("p[0] <> ''")
    rows = lines.select(F.unbase64(F.col("p")[0]).alias("token"), F.col("p")[1].cast("int").alias("rank"), "i", F.size("p").alias("n"))
    if not strict:
        return rows.groupBy("token").agg(F.max_by("rank", "i").alias("rank"))
    odd = rows.agg((F.count_if((F.col("n") != 2) | F.col("rank").isNull()) > 0) | (F.count("*") != F.count_distinct("token")) | (F.count("*") != F.count_distinct("rank"))).first()[0]
    if odd:
        raise ValueError("the rank file has odd lines, or repeated tokens or ranks")
    return rows.select("token", "rank")


def scan_blob(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    content = spark.read.format("binaryFile").load(path).select("content").first()["content"]
    return ranks_table(spark, parse_blob(bytes(content), strict))


def ranks_table(spark: SparkSession, ranks: dict[bytes, int]) -> DataFrame:
    return spark.createDataFrame([(bytearray(t), r) for t, r in ranks.items()], "token binary, rank int")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content): files as raw bytes. Spark's file source passes over empty files."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def framed_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): files as texts, invalid UTF-8 replaced."""
    return text_files(spark, path).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256): checksums of files, as lowercase hexadecimal."""
    return text_files(spark, path).select("path", F.sha2("content", 256).alias("sha256"))
