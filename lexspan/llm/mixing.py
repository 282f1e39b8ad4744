"""Soft-membership mixing of sources to target weights.

A Bernoulli naive Bayes classifier, fitted with DataFrame counts on the labelled table, gives each document posteriors over domains
(features: presence of telling words and of bands of surface measures). Distributed projected-gradient least squares then fits
nonnegative document rates r so that the expected domain totals sum_i r_i * tokens_i * posterior_id meet the targets. Each step is one
aggregate over the stored posteriors: with M = sum_i tokens_i p_i p_i', r_i <- max(0, r_i - p_i' M^-1 (A(r) - T)), a gradient step
in the metric of token counts whose step length 1 never overshoots. Rates stay expressions; the driver holds a few numbers per domain.

DataFrame functions only. At most `max_train` labelled documents (smallest hashes of ids) train, and `n_features` features are kept (a
bound, so the model is a literal; those that more than MOST_SHARE of the labelled documents have aren't features); all documents, long ones whole,
get posteriors and rates. Null and empty texts have no tokens, posteriors by the classifier's prior, and no say in the totals. Null ids keep
their row. Domains without labelled documents drop out, targets are scaled to the rest; without labels there is one domain and all rates
are 1. Ties and repeated rows get equal rates. Added columns whose name the input has get an underscore more. Empty tables give empty results.
`copies` is floor(rate), plus one with the chance of the fraction, by the hash of the id; taken() repeats the rows by it."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import drop_stored, stored, unused

# fixed values: what is not a letter; junk marks that are counted
NOT_LETTER = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SHRINK = 5.0  # documents' worth of the overall share in each domain's share
LEAST_CHI, MOST_SHARE = 16.0, 0.15  # common features say little each, and say it together
MARK = r"[!|$&#%*]"


def words(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), NOT_LETTER)


def bands(text: Column, w: Column) -> Column:
    """The bands that a text's surface measures fall in."""
    n = F.size(w)
    mark = F.concat(F.lit("\u0001mark"), F.least(F.lit(8), F.ceil(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(MARK)) / n * 8)).cast("string"))
    spread = F.concat(F.lit("\u0001spread"), F.floor(F.log2(n.cast("double") + 1)).cast("string"), F.lit("/"), F.floor(8 * F.size(F.array_distinct(w)) / n).cast("string"))
    return F.array(spread, mark)


def fit_domains(docs: DataFrame, labels: DataFrame, domain: Column, id_col: str, text_col: str, max_train: int, n_features: int) -> tuple[list[str], list[float], dict[str, list[float]]]:
    """Domains, the logarithm of each one's prior times its chances of no feature, and for each feature its log odds by domain."""
    lab = labels.select(F.col(id_col).alias("mix_id"), domain.cast("string").alias("mix_domain")).dropna().orderBy(F.xxhash64("mix_id"), "mix_id", "mix_domain").limit(max_train)
    rows = docs.select(F.col(id_col).alias("mix_id"), F.col(text_col).alias("t")).join(F.broadcast(lab), "mix_id").select("mix_domain", "t", words(F.col("t")).alias("w"))
    rows = stored(rows.select("mix_domain", F.concat(F.array_distinct("w"), bands(F.col("t"), F.col("w"))).alias("f")), "labelled")
    sizes = {r[0]: r[1] for r in rows.groupBy("mix_domain").count().collect()}
    if not sizes:
        return [], [], {}
    names, n_all = sorted(sizes), sum(sizes.values())
    n = rows.select("mix_domain", F.explode("f").alias("f")).where("f <> ''").groupBy("f").agg(*(F.sum((F.col("mix_domain") == d).cast("long")).alias(f"n{i}") for i, d in enumerate(names)))
    total = sum((F.col(f"n{i}") for i in range(len(names))), F.lit(0))
    chi = sum(((F.col(f"n{i}") - total * sizes[d] / n_all) ** 2 / (total * sizes[d] / n_all) for i, d in enumerate(names)), F.lit(0.0))
    best = n.where((total >= 4) & (total <= MOST_SHARE * n_all)).withColumn("chi", chi).where(F.col("chi") >= LEAST_CHI).orderBy(F.desc("chi"), "f").limit(n_features).collect()
    start, odds = [math.log(sizes[d] / n_all) for d in names], {}
    for r in best:
        overall = (sum(r[f"n{i}"] for i in range(len(names))) + 0.5) / (n_all + 1)
        p = [(r[f"n{i}"] + SHRINK * overall) / (sizes[d] + SHRINK) for i, d in enumerate(names)]
        odds[r["f"]] = [math.log(x / (1 - x)) for x in p]
        start = [s + math.log(1 - x) for s, x in zip(start, p, strict=True)]
    drop_stored(rows)
    return names, start, odds


def posteriors(docs: DataFrame, text_col: str, model: tuple[list[str], list[float], dict[str, list[float]]]) -> DataFrame:
    """docs with mix_tokens and mix_p (an array by domain) added."""
    names, start, odds = model
    out = docs.withColumn("mix_w", words(F.col(text_col)))
    out = out.withColumn("mix_tokens", F.size(F.filter("mix_w", lambda x: x != "")).cast("long"))
    if not odds:
        return out.withColumn("mix_p", F.array(*(F.lit(math.exp(s)) for s in start)) if names else F.array(F.lit(1.0))).drop("mix_w")
    table = F.create_map(*(x for f, v in odds.items() for x in (F.lit(f), F.array(*map(F.lit, v)))))
    # array_intersect, not filter(): it is compiled with the rest of the row
    known = [F.array(*(F.lit(f) for f in odds if (f[0] == "\u0001") == own), F.lit("\u0001")) for own in (False, True)]
    out = out.withColumn("mix_f", F.concat(F.array_intersect(known[0], F.col("mix_w")), F.array_intersect(known[1], bands(F.col(text_col), F.col("mix_w")))))
    add = lambda acc, f: F.zip_with(acc, F.element_at(table, f), lambda a, b: a + b)
    out = out.withColumn("mix_l", F.when(F.size("mix_f") >= 0, F.aggregate("mix_f", F.array(*map(F.lit, start)), add)))  # named twice, so that Spark doesn't move mix_f into the interpreted aggregate
    e = F.transform("mix_l", lambda x: F.exp(x - F.array_max("mix_l")))
    return out.withColumn("mix_e", e).withColumn("mix_p", F.transform("mix_e", lambda x: x / F.aggregate("mix_e", F.lit(0.0), lambda a, b: a + b))).drop("mix_w", "mix_f", "mix_l", "mix_e")


def fit_rates(table: DataFrame, targets: list[float], most_steps: int = 40, near: float = 1e-6) -> Column:
    """The rate of each row of a table with mix_tokens and mix_p0, mix_p1, ..., as an expression. targets: shares by domain."""
    d = len(targets)
    t, p = F.col("mix_tokens").cast("double"), [F.col(f"mix_p{i}") for i in range(d)]
    got = table.agg(F.sum(t).alias("n"), *(F.sum(t * p[i] * p[j]).alias(f"m{i}_{j}") for i in range(d) for j in range(i, d))).first()
    n = got["n"] or 0.0
    rate = F.lit(1.0)
    if not n:
        return rate
    m = np.array([[got[f"m{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)])
    inverse, goal = np.linalg.pinv(m + np.eye(d) * 1e-9 * n), np.array(targets) * n
    for _ in range(most_steps):
        a = table.agg(*(F.sum(t * rate * x).alias(f"a{i}") for i, x in enumerate(p))).first()
        off = np.array(a, float) - goal
        if np.abs(off).max() <= near * n:
            break
        step = inverse @ off
        rate = F.greatest(F.lit(0.0), rate - sum((x * float(s) for x, s in zip(p[1:], step[1:], strict=True)), p[0] * float(step[0])))
    return rate


ADDED = ("mix_tokens", "mix_p", "rate", "copies")


def mix(docs: DataFrame, labels: DataFrame, domain: Column, targets: dict[str, float], keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", max_train: int = 6000, n_features: int = 300) -> DataFrame:
    """The kept columns of docs (all of them by default) with mix_tokens, mix_p (posteriors, by sorted domain name), rate and copies added
    (under the names that names_in() gives). domain: a column of labels."""
    model = fit_domains(docs, labels, domain, id_col, text_col, max_train, n_features)
    names = model[0] or [""]
    wanted = [targets.get(x, 0.0) for x in names]
    wanted = [x / sum(wanted) for x in wanted] if sum(wanted) > 0 else [1 / len(names)] * len(names)
    held = docs.columns if keep is None else keep
    own = {c: f"in{i}" for i, c in enumerate(dict.fromkeys([*held, id_col, text_col]))}  # names of the input can't clash with ours
    base = docs.select(*(F.col(f"`{c}`").alias(x) for c, x in own.items()))
    ids = own[id_col]
    full = stored(posteriors(base, own[text_col], model).select(*dict.fromkeys([*(own[c] for c in held), ids]), "mix_tokens", "mix_p"), "posteriors")
    flat = full.select("*", *(F.col("mix_p")[i].alias(f"mix_p{i}") for i in range(len(names))))
    out = flat.withColumn("rate", fit_rates(flat, wanted))
    chance = F.pmod(F.xxhash64(F.col(ids)), F.lit(1 << 20)) / float(1 << 20)
    out = out.withColumn("copies", (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long")).cast("long"))
    return out.select(*(F.col(own[c]).alias(c) for c in held), *(F.col(c).alias(x) for c, x in zip(ADDED, names_in(held), strict=True)))


def names_in(columns: list[str]) -> list[str]:
    """The names of the columns that mix() adds to these."""
    return [unused(c, columns) for c in ADDED]


def taken(mixed: DataFrame, copies_col: str = "copies") -> DataFrame:
    """Each row as often as its copies say, numbered from 1 in that column; rows without copies go. So the shares of tokens are the targets, but
    for the rounding of rates by chance."""
    n = F.col(f"`{copies_col}`")
    rest = [F.col(f"`{c}`") for c in mixed.columns if c != copies_col]
    return mixed.where(n > 0).select(*rest, F.explode(F.sequence(F.lit(1).cast("long"), n)).alias(copies_col)).select(*(F.col(f"`{c}`") for c in mixed.columns))
