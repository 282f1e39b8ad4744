"""The queries opN_<name> over the driver's tables, each one operator with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontam, lm, mixing, neardup, pii, quality, repeats, secrets, toxicity
from ._common import LETTERS, read


def remainder(id_col: str, n: int) -> Column:
    """The remainder that sets rows apart; -1 for a null id, which is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % n, F.lit(-1))


def op1_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    model = quality.fit_quality(docs, read(spark, d, "labels"), train_where=remainder("id", 4) != 2)
    return quality.score_quality(docs, model).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted", "n_passages")


def op2_lm_scores(spark: SparkSession, d: str) -> DataFrame:
    return lm.score_texts(read(spark, d, "documents"), remainder("doc_id", 7) == 2)


def op3_pii(spark: SparkSession, d: str) -> DataFrame:
    found = pii.sanitise(read(spark, d, "documents").select("doc_id", "text"))
    return found.select("doc_id", *(pii.count_kind(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)), F.sha2(pii.as_text(F.col("pii_base")), 256).alias("base_sha256"), pii.as_text(F.col("pii_spans")).alias("spans"))


#: shares of tokens by quality and toxicity of the labels
TARGETS = {"q1t0": 0.8, "q0t0": 0.15, "q1t1": 0.04, "q0t1": 0.01}


def op4_mixing(spark: SparkSession, d: str) -> DataFrame:
    domain = F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string"))
    mixed = mixing.mix(read(spark, d, "documents").select("doc_id", "text"), read(spark, d, "labels"), domain, TARGETS, keep=["doc_id"])
    return mixed.select("doc_id", F.col("mix_tokens").alias("n_tokens"), F.col("mix_p").alias("posteriors"), "rate", "copies")


def op5_ann(spark: SparkSession, d: str) -> DataFrame:
    return ann.search(read(spark, d, "embeddings"), F.col("id") % 20 == 0)


def op6_decontamination(spark: SparkSession, d: str) -> DataFrame:
    found = decontam.contamination(read(spark, d, "documents"), read(spark, d, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, read(spark, d, "labels")))


def op8_near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, d, "documents"), k=3, percent=85)


def op9_repeats(spark: SparkSession, d: str) -> DataFrame:
    return repeats.remove_repeats(read(spark, d, "documents"), with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_secrets(spark: SparkSession, d: str) -> DataFrame:
    return secrets.scan_secrets(read(spark, d, "documents"))


def base_pii(spark: SparkSession, d: str) -> DataFrame:
    """What is fixed by the texts alone of op3."""
    return op3_pii(spark, d).drop("spans")


def base_secrets(spark: SparkSession, d: str) -> DataFrame:
    """What is fixed by the texts alone of op10."""
    return op10_secrets(spark, d).drop("spans")


def base_lm(spark: SparkSession, d: str) -> DataFrame:
    """What is fixed by the texts alone of op2; sums of logarithms are rounded, as they depend on the order."""
    return op2_lm_scores(spark, d).drop("score").withColumn("base_score", F.round("base_score", 2))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_lm_scores, op3_pii, op4_mixing, op5_ann, op6_decontamination, op7_toxicity, op8_near_duplicates, op9_repeats, op10_secrets, base_pii, base_secrets, base_lm)}


UPPER, LOWER = LETTERS
#: words and ten-word windows; a shorter item is one window, so documents are cut at every length that items have
DECONTAMINATION_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL),
sized AS (SELECT item_id, ws, least(len(ws), 10) AS n FROM b WHERE len(ws) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS gram FROM sized, unnest(range(1, len(ws) - n + 2)) AS u(i)),
grams AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS gram FROM d, (SELECT DISTINCT n FROM windows), unnest(range(1, len(ws) - n + 2)) AS u(i)),
hits AS (SELECT doc_id, i, n, item_id FROM grams JOIN windows USING (n, gram)),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM hits, unnest(range(i, i + n)) AS u(j) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS listed FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""
#: shared shingles are counted between distinct sets; labels then spread along the links
NEAR_DUPLICATES_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS (SELECT doc_id, list_sort(list_distinct([array_to_string(ws[i:i + 2], ' ') FOR i IN range(1, greatest(len(ws) - 2, 1) + 1)])) AS s FROM d WHERE len(ws) > 0),
classes AS (SELECT s, len(s) AS n, min(doc_id) AS c FROM sets GROUP BY s),
shingles AS (SELECT c, n, x FROM classes, unnest(s) AS u(x)),
links AS (SELECT a.c AS p, b.c AS q FROM shingles a JOIN shingles b ON a.x = b.x AND a.c <> b.c AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reached(c, label) AS (SELECT c, c FROM classes UNION SELECT q, label FROM reached JOIN links ON p = c WHERE label < q),
labels_of AS (SELECT c, min(label) AS label FROM reached GROUP BY c)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(label, doc_id) AS component_id, coalesce(label, doc_id) = doc_id AS kept
FROM documents LEFT JOIN sets USING (doc_id) LEFT JOIN classes USING (s) LEFT JOIN labels_of USING (c)"""
#: a word goes if one of the thirteen windows that cover it starts in a document with a smaller id, too
REPEATS_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
words AS (SELECT doc_id, i, ws[i] AS word, CASE WHEN i + 12 <= len(ws) THEN array_to_string(ws[i:i + 12], ' ') END AS gram FROM d, unnest(range(1, len(ws) + 1)) AS u(i)),
first AS (SELECT gram, min(doc_id) AS first_id FROM words WHERE gram IS NOT NULL GROUP BY gram),
marked AS (SELECT doc_id, i, word, max(coalesce(first_id < doc_id, false)::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS 12 PRECEDING) AS gone FROM words LEFT JOIN first USING (gram)),
kept AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS rest FROM marked GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""




def _spans_sql(kinds: dict[str, tuple[str, str]], order: str) -> str:
    """CTEs up to listed(doc_id, n_..., base): spans by gaps between the matches of each kind's pattern. A kind has a pattern and a
    condition on the match m and its second group g."""
    one = []
    for i, (kind, (pattern, good)) in enumerate(kinds.items()):
        p = pattern.replace("'", "''")
        group = f"regexp_extract_all(t, '{p}', 2)" if pattern.count("(") > 1 and kind == "assign" else f"regexp_extract_all(t, '{p}')"
        one.append(f"SELECT doc_id, {i} AS k, '{kind}' AS kind, start, start + length(m) AS stop FROM (SELECT doc_id, m, g, (sum(length(gap)) OVER w + sum(length(m)) OVER w - length(m))::BIGINT AS start FROM (SELECT doc_id, i, gaps[i] AS gap, ms[i] AS m, gs[i] AS g FROM (SELECT doc_id, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}') AS ms, {group} AS gs FROM d), unnest(range(1, len(ms) + 1)) AS u(i)) WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE {good}")
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in kinds)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(one)}),
listed AS (SELECT doc_id, {counts}, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY {order}) AS base FROM found GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in kinds)}, sha256(coalesce(base, '')) AS base_sha256 FROM d LEFT JOIN listed USING (doc_id)"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum([CASE WHEN i % 2 = 1 THEN x ELSE 2 * x - CASE WHEN x > 4 THEN 9 ELSE 0 END END FOR x, i IN [CAST(c AS INT) FOR c IN string_split(reverse({_DIGITS}), '')]]) % 10 = 0"
PII_SQL = _spans_sql(
    {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        "ip": (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "list_bool_and([length(ltrim(x, '0')) <= 3 AND coalesce(TRY_CAST(ltrim(x, '0') AS INT), 0) <= 255 FOR x IN string_split(m, '.')])"),
        "card": (r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}"),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 8 AND 15"),
    },
    "k, start",
)
_ASSIGN = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
SECRETS_SQL = _spans_sql(
    {
        "assign": (rf"""({_ASSIGN})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "length(g) >= 6"),
        "access": (r"AKIA[A-Z0-9]+", "length(m) >= 20"),
        "hex": (r"[0-9a-f]+", "length(m) >= 24"),
    },
    "start, k",
)
#: crc32 byte by byte, each in eight steps
_CRC = "xor(4294967295::BIGINT, list_reduce([c for c in [4294967295::BIGINT] || [ascii(x)::BIGINT FOR x IN string_split(doc_id::VARCHAR, '')]], lambda a, x: list_reduce([xor(a, x)] || [0, 0, 0, 0, 0, 0, 0, 0], lambda b, y: CASE WHEN b % 2 = 1 THEN xor(b // 2, 3988292384) ELSE b // 2 END)))"
LM_SQL = rf"""
WITH d AS (SELECT doc_id, {_CRC} % 7 = 2 AS held_out, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+'), []) || [chr(10)] AS ws FROM documents),
words AS (SELECT doc_id, held_out, unnest(ws) AS w FROM d),
counted AS (SELECT w, count(*) AS c FROM words WHERE NOT held_out GROUP BY w),
totals AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM counted)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n)::BIGINT AS train_tokens, round(sum(log10(coalesce(c, 0) + 1) - log10(n + v + 1)), 2) AS base_score
FROM words LEFT JOIN counted USING (w), totals GROUP BY doc_id, held_out"""


def oracle_sql() -> dict[str, str]:
    """SQL of the operators whose result is fixed by the texts alone, and of that part of others; the rest learns, or searches approximately."""
    return {"op6_decontamination": DECONTAMINATION_SQL, "op8_near_duplicates": NEAR_DUPLICATES_SQL, "op9_repeats": REPEATS_SQL, "base_pii": PII_SQL, "base_secrets": SECRETS_SQL, "base_lm": LM_SQL}
