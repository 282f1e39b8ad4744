"""Queries over the driver's tables, one for each operator, and the same in SQL.

Merges are checked in SQL with a small vocabulary, trained from a fixed text, that both sides hold; the large vocabulary is checked in
the tests against another implementation."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .encoding import Encoding, get_encoding
from .functions import text as T
from .operators import chat, layout, train
from .operators.codec import Codec
from .registry import CL100K, O200K, R50K, encodings_table, model_encoding_column
from .plans.sql import register_generators, split_sql
from .sources.ranks import file_digests, parse_blob, rank_file_path, ranks_table, scan_ranks, write_blob

LETTERS = r"[A-Za-z]+|[^A-Za-z]"
SEED = "the one that is an other and the for in inn ention eration here there on are was with ing nd Customer Supplier deposits requests furiously carefully " * 3


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@lru_cache(1)
def small() -> Encoding:
    """A vocabulary of 256 bytes and 80 merges; its split pattern has no look-around, so SQL engines agree on it."""
    return train.train_encoding_from_iterator([SEED], vocab_size=336, name="small", pattern=LETTERS, special_tokens={"<|end|>": 400}, min_frequency=2)


def joined(x: Column) -> Column:
    return F.array_join(F.transform(x, lambda i: i.cast("string")), " ")


def tokens_by_lang(spark: SparkSession, d: str) -> DataFrame:
    c = Codec(spark, get_encoding("r50k_base"))
    return c.count_by(read(spark, d, "documents"), "text", ["lang"]).withColumnRenamed("n_rows", "n_docs")


def small_codec(spark: SparkSession) -> Codec:
    return Codec(spark, small())


def encode_ordinary(spark: SparkSession, d: str) -> DataFrame:
    c = small_codec(spark)
    return read(spark, d, "nation").select("n_nationkey", joined(c.encode_ordinary(F.col("n_name"))).alias("ids"))


def encode_part_names(spark: SparkSession, d: str) -> DataFrame:
    c = small_codec(spark)
    return read(spark, d, "part").select("p_partkey", joined(c.encode_ordinary(F.col("p_name"))).alias("ids"))


def count_tokens(spark: SparkSession, d: str) -> DataFrame:
    c = small_codec(spark)
    return read(spark, d, "conversations").groupBy("role").agg(F.sum(c.count(F.col("text"))).cast("long").alias("n_tokens"), F.count("*").alias("n_turns"))


def within_limit(spark: SparkSession, d: str) -> DataFrame:
    c = small_codec(spark)
    return read(spark, d, "part").select("p_partkey", c.within_limit(F.col("p_name"), 12).cast("long").alias("n"))


def encode_raw_bytes(spark: SparkSession, d: str) -> DataFrame:
    c = small_codec(spark)
    return read(spark, d, "supplier").select("s_suppkey", joined(c.encode_bytes(F.col("s_name").cast("binary"))).alias("ids"))


def special_split(spark: SparkSession, d: str) -> DataFrame:
    c = small_codec(spark)
    t = F.concat("n_name", F.lit("<|end|>"), "n_name", F.lit("<|end|><|end|>"))
    return read(spark, d, "nation").select("n_nationkey", joined(c.encode(t, allowed_special="all")).alias("ids"))


def special_policy(spark: SparkSession, d: str) -> DataFrame:
    c = small_codec(spark)
    t = F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit("<|end|>"))).otherwise(F.col("text"))
    return read(spark, d, "conversations").select("conv_id", "turn", c.encode(t, on_disallowed="null").isNull().alias("refused"))


def single_token_lookup(spark: SparkSession, d: str) -> DataFrame:
    c = small_codec(spark)
    w = read(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("word")).where("word <> ''")
    return c.single_tokens(w, "word").groupBy("token_id").agg(F.count("*").alias("n"))


def decode_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    c = Codec(spark, get_encoding("r50k_base"))
    return read(spark, d, "documents").select("doc_id", F.md5(c.decode(c.encode_ordinary(F.col("text")))).alias("digest"))


def decode_offsets(spark: SparkSession, d: str) -> DataFrame:
    c = small_codec(spark)
    x = c.decode_with_offsets(c.encode_ordinary(F.col("p_name")))
    return read(spark, d, "part").select("p_partkey", x.alias("x")).select("p_partkey", "x.text", joined(F.col("x.offsets")).alias("offsets"))


def encode_generator(spark: SparkSession, d: str) -> DataFrame:
    c = small_codec(spark)
    g = c.encode_generator(read(spark, d, "nation").select("n_nationkey", "n_name"), "n_name")
    return g.select("n_nationkey", F.col("pos").cast("long").alias("pos"), "piece", joined(F.col("ids")).alias("ids"))


def decode_generator(spark: SparkSession, d: str) -> DataFrame:
    c = Codec(spark, get_encoding("r50k_base"))
    return read(spark, d, "documents").select("doc_id", F.md5(F.array_join(c.decode_generator(c.encode_ordinary(F.col("text"))), "")).alias("digest"))


def pieces_query(pattern: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        p = T.pieces(F.col("text"), pattern)
        return read(spark, d, "documents").select("doc_id", p.alias("p")).select("doc_id", F.size("p").cast("long").alias("n"), F.md5(F.array_join("p", "|")).alias("digest"))

    return run


def piece_frequency(spark: SparkSession, d: str) -> DataFrame:
    return train.piece_counts(read(spark, d, "documents"), "text", LETTERS)


def pieces_letter_space(spark: SparkSession, d: str) -> DataFrame:
    p = T.letter_space_pieces(F.col("p_name"))
    return read(spark, d, "part").select("p_partkey", F.array_join(p, "|").alias("pieces"))


def piece_ranges(spark: SparkSession, d: str) -> DataFrame:
    r = T.piece_ranges(T.pieces(F.col("p_name"), LETTERS))
    return read(spark, d, "part").select("p_partkey", F.explode(r).alias("r")).select("p_partkey", F.col("r.start").cast("long").alias("start_byte"), F.col("r.end").cast("long").alias("end_byte"))


def byte_measures(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return read(spark, d, "documents").select(
        "doc_id", T.byte_length(t).cast("long").alias("n_bytes"), T.non_ascii_bytes(t).cast("long").alias("n_non_ascii"), T.nonzero_bytes(t).cast("long").alias("n_nonzero"), T.token_bound(t).cast("long").alias("bound")
    )


def class_boundaries(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", T.class_boundaries(F.col("p_name")).cast("long").alias("n"))


def utf8_bytes(spark: SparkSession, d: str) -> DataFrame:
    v = T.byte_values(F.col("n_name").cast("binary"))
    return read(spark, d, "nation").select("n_nationkey", joined(v).alias("bytes"), T.bytes_from_values(v).cast("string").alias("back"))


def model_to_encoding(spark: SparkSession, d: str) -> DataFrame:
    names = ["gpt-4o", "gpt-4o-2024", "gpt-4-turbo", "ft:gpt-4o:x", "ft:gpt-4:x", "gpt2", "gpt-oss-20b", "none", "davinci"]
    df = spark.createDataFrame([(x,) for x in names], "model string")
    return df.select("model", model_encoding_column(F.col("model")).alias("encoding"))


def encodings(spark: SparkSession, d: str) -> DataFrame:
    return encodings_table(spark)


def vocab_scan(spark: SparkSession, d: str) -> DataFrame:
    v = scan_ranks(spark, str(rank_file_path("r50k_base")), strict=True)
    return v.groupBy(F.octet_length("token").cast("long").alias("n_bytes")).agg(F.count("*").alias("n"), F.max("rank").cast("long").alias("top"))


def token_byte_values(spark: SparkSession, d: str) -> DataFrame:
    return ranks_table(spark, small()._mergeable_ranks).select(F.hex("token").alias("token"), F.col("rank").cast("long").alias("rank")).orderBy("token")


def merge_pairs(spark: SparkSession, d: str) -> DataFrame:
    return train.merge_pairs(ranks_table(spark, small()._mergeable_ranks)).select(F.col("l").cast("long").alias("l"), F.col("r").cast("long").alias("r"), F.col("rank").cast("long").alias("rank"))


def train_pair_counts(spark: SparkSession, d: str) -> DataFrame:
    w = train.piece_counts(read(spark, d, "documents"), "text", LETTERS).select(train.as_ids(F.col("piece")).alias("ids"), "n")
    return train.pair_counts(w).select(F.col("l").cast("long").alias("l"), F.col("r").cast("long").alias("r"), "n")


def train_merges(spark: SparkSession, d: str) -> DataFrame:
    ranks = train.train_ranks(read(spark, d, "documents"), "text", vocab_size=512)[1]
    return ranks_table(spark, ranks).select(F.hex("token").alias("token"), F.col("rank").cast("long").alias("rank"))


def chat_render(spark: SparkSession, d: str) -> DataFrame:
    return chat.conversations(read(spark, d, "conversations")).select("conv_id", F.md5(chat.rendered(F.col("segments"))).alias("digest"), F.size("segments").cast("long").alias("n_segments"))


def chat_count(spark: SparkSession, d: str) -> DataFrame:
    c = small_codec(spark)
    n = c.count_segments(F.col("segments")).cast("long")
    return chat.conversations(read(spark, d, "conversations")).select("conv_id", n.alias("n_tokens"), F.when(n <= 4000, n).alias("within"))


def chunk_layout(spark: SparkSession, d: str) -> DataFrame:
    r = layout.chunk_ranges(F.octet_length("text"), 512, 32)
    return read(spark, d, "documents").select("doc_id", F.explode(r).alias("r")).select("doc_id", *(F.col(f"r.{a}").cast("long").alias(b) for a, b in (("chunk", "chunk"), ("start", "start_byte"), ("end", "end_byte"))))


def filter_by_flags(spark: SparkSession, d: str) -> DataFrame:
    v = T.byte_values(F.col("p_name").cast("binary"))
    keep = layout.keep_flagged(v, F.transform(v, lambda x: x % 2))
    return read(spark, d, "part").select("p_partkey", joined(keep).alias("kept"))


def chunk_owner(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey", layout.owner(F.col("o_orderkey"), 512, 40).cast("long").alias("chunk"))


def encode_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Raw merges of two ranges that overlap, each on its own."""
    c = small_codec(spark)
    data = F.col("p_name").cast("binary")
    n = F.octet_length(data)
    r = F.array(F.struct(F.lit(0).alias("start"), F.least(n, F.lit(9)).alias("end")), F.struct(F.least(n, F.lit(5)).alias("start"), n.alias("end")))
    e = c.encode_ranges(data, r)
    return read(spark, d, "part").select("p_partkey", e.alias("e")).select("p_partkey", joined(F.col("e")[0]).alias("head"), joined(F.col("e")[1]).alias("tail"))


def count_raw_bytes(spark: SparkSession, d: str) -> DataFrame:
    c = small_codec(spark)
    return read(spark, d, "supplier").select("s_suppkey", c.count_bytes(F.col("s_name").cast("binary")).cast("long").alias("n"))


def decode_tokens_bytes(spark: SparkSession, d: str) -> DataFrame:
    c = small_codec(spark)
    t = F.transform(c.decode_tokens_bytes(c.encode_ordinary(F.col("p_name"))), F.hex)
    return read(spark, d, "part").select("p_partkey", F.array_join(t, " ").alias("tokens"))


def token_layout(spark: SparkSession, d: str) -> DataFrame:
    """Byte starts of all tokens of part names that are encoded as byte ranges of one text after the other."""
    c = small_codec(spark)
    t = read(spark, d, "part").select(F.col("p_partkey").alias("range_id"), (F.col("p_partkey") * 64).cast("int").alias("start"), F.posexplode(c.encode_bytes(F.col("p_name").cast("binary"))).alias("pos", "id"))
    lengths = c.vocabulary().select("id", F.octet_length("token").alias("n"))
    out = layout.token_layout(t, F.broadcast(lengths), 64, 1_000_000_000)
    return out.select(F.col("range_id").alias("p_partkey"), *(F.col(x).cast("long").alias(x) for x in ("pos", "token_start", "source_chunk")), "owned")


def train_chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    """Merges learned from pieces that are counted already."""
    counts = train.piece_counts(read(spark, d, "part"), "p_name", LETTERS).toArrow().to_pylist()
    merges = train.train_from_counts([(x["piece"].encode(), x["n"]) for x in counts], 300, 1)
    return ranks_table(spark, train.ranks_from_merges(merges)).select(F.hex("token").alias("token"), F.col("rank").cast("long").alias("rank"))


def blob_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The small vocabulary, written as a binary rank blob and parsed again."""
    return ranks_table(spark, parse_blob(write_blob(small()._mergeable_ranks))).select(F.hex("token").alias("token"), F.col("rank").cast("long").alias("rank"))


def encode_stitched(spark: SparkSession, d: str) -> DataFrame:
    c = small_codec(spark)
    s = layout.encode_stitched(c, read(spark, d, "part").select("p_partkey", "p_name"), "p_name", 16, 8)
    return s.select("p_partkey", joined(F.col("stitched")).alias("ids"))


FILES = "/opt/tokenizers"


def file_name() -> Column:
    return F.element_at(F.split("path", "/"), -1).alias("name")


def file_checksums(spark: SparkSession, d: str) -> DataFrame:
    return file_digests(spark, f"{FILES}/*.tiktoken").select(file_name(), "sha256")


def file_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Whole text files, split by the pattern; null beyond the limit."""
    c = small_codec(spark)
    return c.count_files(f"{FILES}/*.{{txt,md}}").join(c.count_files(f"{FILES}/*.{{txt,md}}", limit=3000).withColumnRenamed("n_tokens", "within"), "path").select(file_name(), F.col("n_tokens").cast("long").alias("n_tokens"), F.col("within").cast("long").alias("within"))


def chat_encode(spark: SparkSession, d: str) -> DataFrame:
    c = small_codec(spark)
    return chat.conversations(read(spark, d, "conversations")).select("conv_id", F.md5(joined(c.encode_segments(F.col("segments"), allowed_special="all"))).alias("digest"))


def chat_names(spark: SparkSession, d: str) -> DataFrame:
    """A name takes the role's place; an empty one counts as a user's."""
    df = read(spark, d, "conversations").withColumn("name", F.when(F.col("turn") % 3 == 1, "bob").when(F.col("turn") % 3 == 2, ""))
    return chat.conversations(df, name_col="name", prime=None).select("conv_id", F.md5(chat.rendered(F.col("segments"))).alias("digest"))


def encode_generator_specials(spark: SparkSession, d: str) -> DataFrame:
    c = small_codec(spark)
    t = read(spark, d, "nation").select("n_nationkey", F.concat("n_name", F.lit("<|end|><|end|>"), "n_name").alias("t"))
    return c.encode_generator(t, "t", allowed_special="all").select("n_nationkey", F.col("pos").cast("long").alias("pos"), "piece", joined(F.col("ids")).alias("ids"))


def single_token_bytes(spark: SparkSession, d: str) -> DataFrame:
    c = small_codec(spark)
    return c.single_token_bytes(spark.range(0, 420), "id").select("id", F.hex("token_bytes").alias("token"))


def encode_ranges_flat(spark: SparkSession, d: str) -> DataFrame:
    """The ids of two ranges in a row, and where each range's begin."""
    c = small_codec(spark)
    data = F.col("p_name").cast("binary")
    n = F.octet_length(data)
    r = F.array(F.struct(F.lit(0).alias("start"), F.least(n, F.lit(9)).alias("end")), F.struct(F.least(n, F.lit(5)).alias("start"), n.alias("end")))
    return read(spark, d, "part").select("p_partkey", c.encode_ranges_flat(data, r).alias("e")).select("p_partkey", joined(F.col("e.ids")).alias("ids"), joined(F.col("e.token_offsets")).alias("token_offsets"))


def valid_ranges(spark: SparkSession, d: str) -> DataFrame:
    r = F.array(F.struct((F.col("p_size") - 5).alias("start"), F.col("p_size").alias("end")), F.struct(F.lit(2).alias("start"), F.lit(4).alias("end")))
    return read(spark, d, "part").select("p_partkey", layout.valid_ranges(r, F.octet_length("p_name")).alias("ok"))


def low_entropy(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", T.low_entropy(F.col("p_name").cast("binary"), least=8, kinds=11, share=0.12).alias("low"))


def sql_generators(spark: SparkSession, d: str) -> DataFrame:
    """The table functions: each piece with its ids, and the text that these give."""
    register_generators(spark, small(), "small_")
    read(spark, d, "nation").createOrReplaceTempView("lexspan_nation")
    return spark.sql("SELECT n_nationkey, CAST(g.pos AS BIGINT) AS pos, g.piece, array_join(transform(g.ids, i -> CAST(i AS STRING)), ' ') AS ids, (SELECT array_join(array_agg(part), '') FROM small_decode_generator(array(97, 98))) AS ab FROM lexspan_nation, LATERAL small_encode_generator(n_name) g")


def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """The registered functions, over an SQL split."""
    small_codec(spark).register("small_")
    p = split_sql("p_name", LETTERS)
    read(spark, d, "part").createOrReplaceTempView("lexspan_part")
    return spark.sql(f"SELECT p_partkey, CAST(small_count_pieces({p}) AS BIGINT) AS n, CAST(small_decode_bytes(small_encode_pieces({p})) AS STRING) AS text FROM lexspan_part")


QUERIES = (
    tokens_by_lang, encode_ordinary, encode_part_names, count_tokens, within_limit, encode_raw_bytes, special_split, special_policy, single_token_lookup, decode_roundtrip, decode_offsets, encode_generator,
    decode_generator, piece_frequency, pieces_letter_space, piece_ranges, byte_measures, class_boundaries, utf8_bytes, model_to_encoding, encodings, vocab_scan, token_byte_values, merge_pairs,
    train_pair_counts, train_merges, chat_render, chat_count, chunk_layout, filter_by_flags, chunk_owner, encode_stitched,
    encode_ranges, count_raw_bytes, decode_tokens_bytes, token_layout, train_chunk_counts, blob_roundtrip,
    file_checksums, file_token_counts, chat_encode, chat_names, encode_generator_specials, single_token_bytes, encode_ranges_flat, valid_ranges, low_entropy, sql_functions, sql_generators,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES} | {"pieces_r50k": pieces_query(R50K), "pieces_cl100k": pieces_query(CL100K), "pieces_o200k": pieces_query(O200K)}


def _merge_sql(source: str, key: str, text: str, framed: bool = True) -> str:
    """CTEs up to ids(key, pos, piece, parts): every piece with its final tokens, as a list of hexadecimal strings."""
    vocab = ", ".join(f"('{t.hex()}', {r})" for t, r in small()._mergeable_ranks.items())
    split = f"regexp_extract_all({text}, '{LETTERS}')" if framed else f"[{text}]"
    return f"""WITH RECURSIVE vocab(tok, rnk) AS (VALUES {vocab}),
src AS (SELECT {key} AS k, {split} AS ps FROM {source}),
pos AS (SELECT k, i, ps[i] AS piece FROM src, unnest(range(1, len(ps) + 1)) AS u(i)),
bpe(piece, parts) AS (
  SELECT DISTINCT piece, [lower(hex(encode(piece)))[2 * j - 1:2 * j] FOR j IN range(1, strlen(piece) + 1)] FROM pos
  UNION ALL
  SELECT piece, parts[1:b - 1] || [parts[b] || parts[b + 1]] || parts[b + 2:] FROM (
    SELECT piece, parts, arg_min(j, rnk * 1000000 + j) AS b FROM bpe, unnest(range(1, len(parts))) AS u(j) JOIN vocab ON tok = parts[j] || parts[j + 1] GROUP BY piece, parts)),
done AS (SELECT piece, arg_min(parts, len(parts)) AS parts FROM bpe GROUP BY piece)
"""


def _ids_sql(source: str, key: str, text: str, framed: bool = True) -> str:
    return _merge_sql(source, key, text, framed) + f"""SELECT s.k AS {key}, coalesce(x.ids, '') AS ids FROM src s LEFT JOIN (
SELECT k, string_agg(rnk::VARCHAR, ' ' ORDER BY i, j) AS ids FROM (SELECT k, i, j, parts[j] AS tok FROM pos JOIN done USING (piece), unnest(range(1, len(parts) + 1)) AS u(j)) JOIN vocab USING (tok) GROUP BY k) x USING (k)"""


WHITE = r"\t\n\x0b\f\r \x{85}\p{Z}"


def _pieces_list(pattern: str, wide: str) -> str:
    """Split in an engine without look-ahead: a mark is put before the last of several white-space characters that others follow."""
    mark = ""
    last = WHITE if pattern == "r50k" else WHITE.replace(r"\n", "").replace(r"\r", "")
    q = wide.replace("'", "''")
    return f"""regexp_extract_all(regexp_replace(text, '([{WHITE}])([{last}])([^{WHITE}])', '\\1{mark}\\2\\3', 'g'), '{q}')"""


def _pieces_sql(pattern: str, wide: str) -> str:
    return f"SELECT doc_id, len(p)::BIGINT AS n, md5(array_to_string(p, '|')) AS digest FROM (SELECT doc_id, {_pieces_list(pattern, wide)} AS p FROM documents)"


def _train_sql(pieces: str, steps: int, least: int) -> str:
    """Learning from a list of (piece): an id is a character (20000 + id), so that a merge is a replacement in a string."""
    return f"""WITH RECURSIVE counted AS (SELECT hex(encode(piece)) AS h, count(*) AS n FROM ({pieces}) WHERE strlen(piece) > 1 GROUP BY piece),
state(i, w, n, p) AS (
  SELECT 0, array_to_string([chr(20000 + ('0x' || h[2 * j - 1:2 * j])::INT) FOR j IN range(1, len(h) // 2 + 1)], ''), n, '' FROM counted
  UNION ALL
  SELECT i + 1, replace(w, b.pair, chr(20256 + i)), n, b.pair FROM state, (
    SELECT w[j:j + 1] AS pair, sum(n) AS c FROM state, unnest(range(1, length(w))) AS u(j) GROUP BY pair ORDER BY c DESC, pair LIMIT 1) b
  WHERE i < {steps} AND length(w) > 1 AND c >= {least}),
merges AS (SELECT DISTINCT i - 1 AS i, p FROM state WHERE i > 0),
spelled(i, s, k) AS (SELECT i, p, i - 1 FROM merges UNION ALL SELECT x.i, replace(s, chr(20256 + k), m.p), k - 1 FROM spelled x JOIN merges m ON m.i = k),
tokens AS (SELECT array_to_string([printf('%02X', unicode(s[j]) - 20000) FOR j IN range(1, length(s) + 1)], '') AS token, 256 + i AS rank FROM spelled WHERE k < 0
  UNION ALL SELECT printf('%02X', r), r FROM range(256) AS t(r))
SELECT token, max(rank)::BIGINT AS rank FROM tokens GROUP BY token"""


def _count_sql(pieces: str) -> str:
    """Token counts by language with the vocabulary that the rank file holds."""
    return f"""WITH RECURSIVE vocab AS (SELECT hex(from_base64(column0)) AS tok, column1::BIGINT AS rnk FROM read_csv('{rank_file_path("r50k_base")}', delim=' ', header=false, quote='', escape='', columns={{'column0': 'VARCHAR', 'column1': 'BIGINT'}})),
pos AS (SELECT lang, unnest({pieces}) AS piece FROM documents),
seen AS (SELECT lang, hex(encode(piece)) AS h, count(*) AS n FROM pos GROUP BY ALL),
bpe(h, parts) AS (
  SELECT h, CASE WHEN h IN (SELECT tok FROM vocab) THEN [h] ELSE [h[2 * j - 1:2 * j] FOR j IN range(1, len(h) // 2 + 1)] END FROM (SELECT DISTINCT h FROM seen)
  UNION ALL
  SELECT h, parts[1:b - 1] || [parts[b] || parts[b + 1]] || parts[b + 2:] FROM (
    SELECT h, parts, arg_min(j, rnk * 1000000 + j) AS b FROM bpe, unnest(range(1, len(parts))) AS u(j) JOIN vocab ON tok = parts[j] || parts[j + 1] GROUP BY h, parts)),
done AS (SELECT h, min(len(parts)) AS k FROM bpe GROUP BY h),
docs AS (SELECT lang, count(*) AS n_docs FROM documents GROUP BY lang)
SELECT docs.lang, n_docs, coalesce(n_tokens, 0)::BIGINT AS n_tokens FROM docs LEFT JOIN (SELECT lang, sum(n * k) AS n_tokens FROM seen JOIN done USING (h) GROUP BY lang) x ON x.lang IS NOT DISTINCT FROM docs.lang"""


def oracle_sql() -> dict[str, str]:
    m = ""
    o200k = O200K.replace(r"|\s+(?!\S)", "").replace(r"[^\r\n\p{L}\p{N}]", rf"[^\r\n\p{{L}}\p{{N}}{m}]").replace(r"[^\s\p{L}\p{N}]", rf"[^{WHITE}\p{{L}}\p{{N}}{m}]").replace(r"\s", f"[{WHITE}]")
    cl100k = rf"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{{L}}\p{{N}}{m}]?\p{{L}}+|\p{{N}}{{1,3}}| ?[^{WHITE}\p{{L}}\p{{N}}{m}]+[\r\n]*|[{WHITE}]+$|[{WHITE}]*[\r\n]|[{WHITE}]+"
    r50k = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}{m}]+|[{WHITE}]+"
    specials = f"SELECT n_nationkey, a || ' 400 ' || a || ' 400 400' AS ids FROM (SELECT n_nationkey, ids AS a FROM ({_ids_sql('nation', 'n_nationkey', 'n_name')}))"
    vocab = ", ".join(f"('{t.hex().upper()}', {r})" for t, r in small()._mergeable_ranks.items())
    words = "SELECT unnest(string_split(text, ' ')) AS word FROM documents"
    count = "SELECT k, sum(len(parts))::BIGINT AS n FROM pos JOIN done USING (piece) GROUP BY k"
    role_of = lambda name: "'[[role:' || CASE WHEN coalesce(" + name + ", '') = '' THEN 'user' ELSE " + name + " END || ']]' || chr(10)"
    turns = lambda role: f"SELECT conv_id, turn * 3 + 1 AS o, {role_of(role)} AS s FROM conversations UNION ALL SELECT conv_id, turn * 3 + 2, text FROM conversations WHERE coalesce(text, '') <> '' UNION ALL SELECT conv_id, turn * 3 + 3, chr(10) || '[[/message]]' || chr(10) FROM conversations"
    segs = f"({turns('role')} UNION ALL SELECT DISTINCT conv_id, 1000000000, '[[role:assistant]]' || chr(10) FROM conversations)"
    named = turns("(CASE turn % 3 WHEN 1 THEN 'bob' WHEN 2 THEN '' ELSE role END)")
    chunks = "(SELECT p_partkey, c, greatest(0, c * 16 - 8) AS s, p_name[greatest(0, c * 16 - 8) + 1:least(length(p_name), (c + 1) * 16 + 8)] AS t, (length(p_name) + 15) // 16 AS k FROM part, unnest(range(0, (length(p_name) + 15) // 16)) AS u(c))"
    stitched = f"""SELECT p_partkey, coalesce(ids, '') AS ids FROM part LEFT JOIN (SELECT (k)[1] AS p_partkey, string_agg(rnk::VARCHAR, ' ' ORDER BY (k)[2], j) AS ids FROM
(SELECT k, j, parts[j] AS tok, least(((k)[3] + strlen(array_to_string(parts[:j - 1], '')) // 2) // 16, (k)[4] - 1) AS own FROM pos JOIN done USING (piece), unnest(range(1, len(parts) + 1)) AS u(j)) JOIN vocab USING (tok) WHERE own = (k)[2] GROUP BY 1) USING (p_partkey)"""
    texts = f"(SELECT parse_filename(filename) AS name, content FROM read_text(['{FILES}/*.txt', '{FILES}/*.md']))"
    range_sql = lambda col, text: "SELECT k AS p_partkey, ids AS " + col + " FROM (" + _ids_sql("part", "p_partkey", text, framed=False).replace("AS p_partkey", "AS k") + ")"
    ranks = rank_file_path("r50k_base")
    return {
        "tokens_by_lang": _count_sql(_pieces_list("r50k", r50k)),
        "vocab_scan": f"SELECT octet_length(tok)::BIGINT AS n_bytes, count(*) AS n, max(rnk) AS top FROM (SELECT from_base64(a) AS tok, b AS rnk FROM read_csv('{ranks}', delim=' ', header=false, quote='', escape='', columns={{'a': 'VARCHAR', 'b': 'BIGINT'}})) GROUP BY 1",
        "encodings": "SELECT * FROM (VALUES ('o200k_base', 200019, 199999, 'o200k_base', 2), ('o200k_harmony', 200019, 199999, 'o200k_base', 2), ('cl100k_base', 100277, 100257, 'cl100k_base', 5), ('p50k_base', 50281, 50256, 'p50k_base', 1), ('p50k_edit', 50281, 50256, 'p50k_base', 1), ('r50k_base', 50257, 50256, 'r50k_base', 1), ('gpt2', 50257, 50256, 'r50k_base', 1)) AS t(name, n_vocab, eot_token, rank_file, n_specials)",
        "encode_ranges": f"SELECT a.p_partkey, head, tail FROM ({range_sql('head', 'p_name[:9]')}) a JOIN ({range_sql('tail', 'p_name[6:]')}) b ON a.p_partkey = b.p_partkey",
        "count_raw_bytes": _merge_sql("supplier", "s_suppkey", "s_name", framed=False) + f"SELECT s.k AS s_suppkey, coalesce(c.n, 0)::BIGINT AS n FROM src s LEFT JOIN ({count}) c USING (k)",
        "decode_tokens_bytes": _merge_sql("part", "p_partkey", "p_name") + "SELECT k AS p_partkey, string_agg(upper(parts[j]), ' ' ORDER BY i, j) AS tokens FROM pos JOIN done USING (piece), unnest(range(1, len(parts) + 1)) AS u(j) GROUP BY k",
        "token_layout": _merge_sql("part", "p_partkey", "p_name", framed=False) + "SELECT p_partkey, pos, token_start, p_partkey AS source_chunk, token_start // 64 = p_partkey AS owned FROM (SELECT k AS p_partkey, (j - 1)::BIGINT AS pos, (k * 64 + strlen(array_to_string(parts[:j - 1], '')) // 2)::BIGINT AS token_start FROM pos JOIN done USING (piece), unnest(range(1, len(parts) + 1)) AS u(j))",
        "train_chunk_counts": _train_sql(f"SELECT unnest(regexp_extract_all(p_name, '{LETTERS}', 0, 's')) AS piece FROM part", 44, 1),
        "train_merges": _train_sql(f"SELECT unnest({_pieces_list('o200k', o200k)}) AS piece FROM documents", 256, 2),
        "blob_roundtrip": f"SELECT * FROM (VALUES {vocab}) AS t(token, rank)",
        "encode_ordinary": _ids_sql("nation", "n_nationkey", "n_name"),
        "encode_part_names": _ids_sql("part", "p_partkey", "p_name"),
        "encode_raw_bytes": _ids_sql("supplier", "s_suppkey", "s_name", framed=False),
        "count_tokens": _merge_sql("(SELECT row_number() OVER () AS rid, role, text FROM conversations)", "(rid, role)", "text") + f"SELECT (s.k)[2] AS role, sum(coalesce(c.n, 0))::BIGINT AS n_tokens, count(*) AS n_turns FROM src s LEFT JOIN ({count}) c USING (k) GROUP BY 1",
        "within_limit": _merge_sql("part", "p_partkey", "p_name") + f"SELECT s.k AS p_partkey, CASE WHEN coalesce(c.n, 0) <= 12 THEN coalesce(c.n, 0) END AS n FROM src s LEFT JOIN ({count}) c USING (k)",
        "special_split": specials,
        "special_policy": "SELECT conv_id, turn, turn % 3 = 0 OR text LIKE '%<|end|>%' AS refused FROM conversations",
        "single_token_lookup": f"WITH vocab(tok, rnk) AS (VALUES {vocab}) SELECT rnk AS token_id, count(*) AS n FROM ({words}) LEFT JOIN vocab ON tok = hex(encode(word)) WHERE word <> '' GROUP BY 1",
        "decode_roundtrip": "SELECT doc_id, md5(text) AS digest FROM documents",
        "decode_generator": "SELECT doc_id, md5(text) AS digest FROM documents",
        "encode_generator": _merge_sql("nation", "n_nationkey", "n_name") + "SELECT k AS n_nationkey, (i - 1)::BIGINT AS pos, piece, string_agg(rnk::VARCHAR, ' ' ORDER BY j) AS ids FROM (SELECT k, i, piece, j, parts[j] AS tok FROM pos JOIN done USING (piece), unnest(range(1, len(parts) + 1)) AS u(j)) JOIN vocab USING (tok) GROUP BY ALL",
        "sql_generators": _merge_sql("nation", "n_nationkey", "n_name") + "SELECT k AS n_nationkey, (i - 1)::BIGINT AS pos, piece, 'ab' AS ab, string_agg(rnk::VARCHAR, ' ' ORDER BY j) AS ids FROM (SELECT k, i, piece, j, parts[j] AS tok FROM pos JOIN done USING (piece), unnest(range(1, len(parts) + 1)) AS u(j)) JOIN vocab USING (tok) GROUP BY ALL",
        "decode_offsets": _merge_sql("part", "p_partkey", "p_name") + "SELECT k AS p_partkey, p_name AS text, string_agg(begins::VARCHAR, ' ' ORDER BY i, j) AS offsets FROM (SELECT k, i, j, coalesce(sum(strlen(parts[j]) // 2) OVER (PARTITION BY k ORDER BY i, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begins FROM pos JOIN done USING (piece), unnest(range(1, len(parts) + 1)) AS u(j)) JOIN part ON p_partkey = k GROUP BY k, p_name",
        "pieces_r50k": _pieces_sql("r50k", r50k), "pieces_cl100k": _pieces_sql("cl100k", cl100k), "pieces_o200k": _pieces_sql("o200k", o200k),
        "piece_frequency": f"SELECT piece, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{LETTERS}', 0, 's')) AS piece FROM documents) GROUP BY piece",
        "pieces_letter_space": "SELECT p_partkey, CASE WHEN regexp_full_match(p_name, '[A-Za-z ]*') THEN array_to_string(regexp_extract_all(p_name, ' ?[A-Za-z]+| +'), '|') END AS pieces FROM part",
        "piece_ranges": f"SELECT p_partkey, (e - strlen(p))::BIGINT AS start_byte, e::BIGINT AS end_byte FROM (SELECT p_partkey, p, sum(strlen(p)) OVER (PARTITION BY p_partkey ORDER BY i) AS e FROM (SELECT p_partkey, i, ps[i] AS p FROM (SELECT p_partkey, regexp_extract_all(p_name, '{LETTERS}') AS ps FROM part), unnest(range(1, len(ps) + 1)) AS u(i)))",
        "byte_measures": "SELECT doc_id, strlen(text)::BIGINT AS n_bytes, (strlen(text) - strlen(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')))::BIGINT AS n_non_ascii, strlen(replace(text, chr(0), ''))::BIGINT AS n_nonzero, ((strlen(text) + 3) // 4)::BIGINT AS bound FROM documents",
        "class_boundaries": "SELECT p_partkey, count(*) FILTER (WHERE c <> d)::BIGINT AS n FROM (SELECT p_partkey, i, c, lead(c) OVER (PARTITION BY p_partkey ORDER BY i) AS d FROM (SELECT p_partkey, i, CASE WHEN x = ' ' THEN 0 WHEN regexp_full_match(x, '[A-Za-z]') THEN 1 WHEN regexp_full_match(x, '[0-9]') THEN 2 WHEN regexp_full_match(x, '[!-~]') THEN 3 ELSE 4 END AS c FROM (SELECT p_partkey, i, p_name[i] AS x FROM part, unnest(range(1, length(p_name) + 1)) AS u(i)))) GROUP BY 1",
        "utf8_bytes": "SELECT n_nationkey, array_to_string([ascii(n_name[i]) FOR i IN range(1, length(n_name) + 1)], ' ') AS bytes, n_name AS back FROM nation",
        "model_to_encoding": "SELECT * FROM (VALUES ('gpt-4o', 'o200k_base'), ('gpt-4o-2024', 'o200k_base'), ('gpt-4-turbo', 'cl100k_base'), ('ft:gpt-4o:x', 'o200k_base'), ('ft:gpt-4:x', 'cl100k_base'), ('gpt2', 'gpt2'), ('gpt-oss-20b', 'o200k_harmony'), ('none', NULL), ('davinci', 'r50k_base')) AS t(model, encoding)",
        "token_byte_values": f"SELECT * FROM (VALUES {vocab}) AS t(token, rank) ORDER BY token",
        "merge_pairs": f"WITH vocab(tok, rnk) AS (VALUES {vocab}) SELECT a.rnk AS l, b.rnk AS r, min(v.rnk) AS rank FROM vocab v, unnest(range(1, strlen(v.tok) // 2)) AS u(i) JOIN vocab a ON a.tok = v.tok[1:2 * i] JOIN vocab b ON b.tok = v.tok[2 * i + 1:] GROUP BY 1, 2",
        "chat_render": f"SELECT conv_id, md5(string_agg(s, '' ORDER BY o)) AS digest, count(*)::BIGINT AS n_segments FROM {segs} GROUP BY conv_id",
        "chat_count": _merge_sql(segs, "(conv_id, o)", "s") + f"SELECT conv_id, n AS n_tokens, CASE WHEN n <= 4000 THEN n END AS within FROM (SELECT (k)[1] AS conv_id, sum(n)::BIGINT AS n FROM ({count}) GROUP BY 1)",
        "chunk_layout": "SELECT doc_id, c::BIGINT AS chunk, greatest(0, c * 512 - 32)::BIGINT AS start_byte, least(n, (c + 1) * 512 + 32)::BIGINT AS end_byte FROM (SELECT doc_id, strlen(text) AS n FROM documents), unnest(range(0, (n + 511) // 512)) AS u(c)",
        "filter_by_flags": "SELECT p_partkey, array_to_string([ascii(p_name[i]) FOR i IN range(1, length(p_name) + 1) IF ascii(p_name[i]) % 2 = 1], ' ') AS kept FROM part",
        "chunk_owner": "SELECT o_orderkey, least(o_orderkey // 512, 39)::BIGINT AS chunk FROM orders",
        "encode_stitched": _merge_sql(chunks, "[p_partkey, c, s, k]", "t", framed=False) + stitched,
        "file_checksums": f"SELECT parse_filename(filename) AS name, sha256(content) AS sha256 FROM read_blob('{FILES}/*.tiktoken')",
        "file_token_counts": _merge_sql(texts, "name", "content") + f"SELECT k AS name, n AS n_tokens, CASE WHEN n <= 3000 THEN n END AS within FROM ({count})",
        "chat_encode": _merge_sql(segs, "(conv_id, o)", "s") + "SELECT (k)[1] AS conv_id, md5(string_agg(rnk::VARCHAR, ' ' ORDER BY (k)[2], i, j)) AS digest FROM (SELECT k, i, j, parts[j] AS tok FROM pos JOIN done USING (piece), unnest(range(1, len(parts) + 1)) AS u(j)) JOIN vocab USING (tok) GROUP BY 1",
        "chat_names": f"SELECT conv_id, md5(string_agg(s, '' ORDER BY o)) AS digest FROM ({named}) GROUP BY conv_id",
        "encode_generator_specials": f"SELECT n_nationkey, p::BIGINT AS pos, CASE WHEN p IN (1, 2) THEN '<|end|>' ELSE n_name END AS piece, CASE WHEN p IN (1, 2) THEN '400' ELSE ids END AS ids FROM ({_ids_sql('nation', 'n_nationkey', 'n_name')}) JOIN nation USING (n_nationkey), unnest(range(0, 4)) AS u(p)",
        "single_token_bytes": f"SELECT id, coalesce(token, CASE WHEN id = 400 THEN '{b'<|end|>'.hex().upper()}' END) AS token FROM range(0, 420) AS r(id) LEFT JOIN (VALUES {vocab}) AS t(token, rank) ON rank = id",
        "encode_ranges_flat": f"SELECT a.p_partkey, concat_ws(' ', nullif(head, ''), nullif(tail, '')) AS ids, '0 ' || (len(string_split(head, ' ')) || ' ' || (len(string_split(head, ' ')) + len(string_split(tail, ' ')))) AS token_offsets FROM ({range_sql('head', 'p_name[:9]')}) a JOIN ({range_sql('tail', 'p_name[6:]')}) b ON a.p_partkey = b.p_partkey",
        "valid_ranges": "SELECT p_partkey, p_size >= 5 AND p_size <= strlen(p_name) AND strlen(p_name) >= 4 AS ok FROM part",
        "low_entropy": "SELECT p_partkey, strlen(p_name) >= 8 AND len(list_distinct(string_split(p_name, ''))) <= 11 AND list_max([len(list_filter(string_split(p_name, ''), lambda y: y = x)) FOR x IN string_split(p_name, '')]) >= 0.12 * strlen(p_name) AS low FROM part",
        "sql_functions": _merge_sql("part", "p_partkey", "p_name") + f"SELECT s.k AS p_partkey, coalesce(c.n, 0)::BIGINT AS n, p_name AS text FROM src s JOIN part ON p_partkey = s.k LEFT JOIN ({count}) c USING (k)",
        "train_pair_counts": f"WITH p AS (SELECT piece, count(*) AS n, lower(hex(encode(piece))) AS h FROM (SELECT unnest(regexp_extract_all(text, '{LETTERS}', 0, 's')) AS piece FROM documents) GROUP BY piece) SELECT ('0x' || h[2 * i - 1:2 * i])::BIGINT AS l, ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT AS r, sum(n)::BIGINT AS n FROM p, unnest(range(1, strlen(piece))) AS u(i) GROUP BY 1, 2",
    }
