"""PII: information-theoretic sanitisation.

Base spans come from patterns: e-mail addresses, IP addresses, card and phone numbers (the protected entities). Then co-occurrence in
the corpus tells what other terms reveal an entity. Around each mention of an entity stands a context of `reach` words on each side. For a term t and an entity e,
with counts of distinct texts (so copies of a text count once, and a text counts once however many entities stand in it),
P(e | t) = n(e, t) / n(t), where n(e, t) texts hold t in a context of e and n(t) texts hold t, and the pointwise mutual information is
log2(P(e | t) / P(e)). A term is disclosing if at least `support` distinct contexts of e hold it, P(e | t) >= `posterior` over all the
term's occurrences in the corpus, and the information is at least `bits`. Disclosing terms become spans of kind `term` wherever they
occur, in texts without an entity too; they are removed, or generalised to their shape where they hold digits. Terms shorter than 4 characters never disclose.

DataFrame functions only. Null texts are empty. Null ids keep their row. Repeated rows give repeated results, and count once as
contexts. Overlapping spans: text is replaced once for their union, in the name of the first. Equal texts get equal results, so ties don't matter.
Texts are read whole, however long. Other columns are left as they are; added ones whose name the input has get an underscore more. Empty
tables give empty results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import drop_stored, fits_broadcast, stored, unused

# fixed values: kinds in the order of the contract, and their patterns. Runs that a match can begin in are entered at their first
# character only (or where the last match ended), and are possessive: the same matches, in linear time.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
SPAN = "array<struct<kind:int,start:int,end:int>>"


def none() -> Column:
    return F.array().cast(SPAN)


def luhn(digits: Column) -> Column:
    d = F.transform(F.reverse(F.split(digits, "")), lambda x: x.cast("int"))
    doubled = F.transform(F.filter(d, lambda x: x.isNotNull()), lambda x, i: F.when(i % 2 == 0, x).otherwise(x * 2 - F.when(x > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _small(part: Column) -> Column:
    """A run of digits that is at most 255."""
    p = F.regexp_replace(part, "^0+(?=.)", "")
    return (F.length(p) <= 3) & (p.cast("int") <= 255)


def accepts(kind: int, m: Column) -> Column:
    if kind == 0:
        return F.lit(True)
    if kind == 1:
        return F.forall(F.split(m, r"\."), lambda p: F.coalesce(_small(p), F.lit(False)))
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == 2:
        return F.length(digits).between(16, 19) & luhn(digits)
    return F.length(digits).between(8, 15)


def spans_of(text: Column, kind: int) -> Column:
    """Places of the accepted matches in code points: the gaps between matches give their starts."""
    pattern = (EMAIL, IP, CARD, PHONE)[kind]
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)
    zero = F.struct(F.lit(0).alias("at"), none().alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["m"])
        one = F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(accepts(kind, x["m"]), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    both = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("m")))
    hint = (F.contains(text, F.lit("@")), text.rlike(r"[0-9]\.[0-9]"), text.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9]"), text.rlike(r"\+[0-9]"))[kind]
    return F.when(hint, F.aggregate(both, zero, step)["out"]).otherwise(none())


def with_spans(docs: DataFrame, text_col: str) -> DataFrame:
    """docs and pii_base: its base spans, by kind, then start."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn("pii_base", F.concat(*(spans_of(t, k) for k in range(4))))


def tokens(s: Column) -> Column:
    """Words are lower-cased one by one, as in places(): lower-casing a whole text can move their bounds."""
    return F.filter(F.transform(F.split(s, r"[^\p{L}\p{N}]+"), lambda w: F.lower(w)), lambda w: F.length(w) > 3)


def places(text: Column, terms: Column) -> Column:
    """Spans (kind 4) of every occurrence of terms in text."""
    word = r"[\p{L}\p{N}]+"
    got, gaps = F.regexp_extract_all(text, F.lit(word), 0), F.split(text, word, -1)
    zero = F.struct(F.lit(0).alias("at"), none().alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["m"])
        one = F.array(F.struct(F.lit(4).alias("kind"), start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.array_contains(terms, F.lower(x["m"])), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(F.zip_with(F.slice(gaps, F.lit(1), F.size(got)), got, lambda g, m: F.struct(g.alias("gap"), m.alias("m"))), zero, step)["out"]


def mentions(found: DataFrame, text_col: str) -> DataFrame:
    """(entity, copy, t, s): each base span with its entity, its text and the text's key."""
    x = found.select(F.col(text_col).alias("t"), F.xxhash64(text_col).alias("copy"), F.explode("pii_base").alias("s"))
    return x.select(F.xxhash64("s.kind", F.substring(F.col("t"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))).alias("entity"), "copy", "t", "s")


def contexts(found: DataFrame, text_col: str, reach: int) -> DataFrame:
    """(entity, copy, ctx, term): the distinct terms of the contexts of each entity, by text. A context is `reach` words on both sides."""
    word, start, end = r"[\p{L}\p{N}]+", F.col("s.start"), F.col("s.end")
    wide = 32 * reach
    all_words = lambda x: F.regexp_extract_all(x, F.lit(word), 0)
    # a near piece does if it holds more than `reach` words (the outermost may be cut), else all that stands on that side is read
    before = all_words(F.substring(F.col("t"), F.greatest(F.lit(1), start + 1 - wide), F.least(start, F.lit(wide))))
    before = F.when((F.size(before) > reach) | (start <= wide), before).otherwise(all_words(F.substring(F.col("t"), F.lit(1), start)))
    after = all_words(F.substring(F.col("t"), end + 1, F.lit(wide)))
    after = F.when((F.size(after) > reach) | (F.length("t") - end <= wide), after).otherwise(all_words(F.substring(F.col("t"), end + 1, F.length("t"))))
    near = F.concat(F.slice(F.reverse(before), 1, reach), F.slice(after, 1, reach))
    near = F.filter(F.transform(near, lambda w: F.lower(w)), lambda w: F.length(w) > 3)
    x = mentions(found, text_col).select("entity", "copy", F.array_distinct(near).alias("near"))
    return x.select("entity", "copy", F.xxhash64(F.array_sort("near")).alias("ctx"), F.explode("near").alias("term")).distinct()


def disclosing(docs: DataFrame, found: DataFrame, text_col: str, reach: int, support: int, posterior: float, bits: float) -> DataFrame:
    """(term): the terms that reveal an entity. Counts of candidates run over every document of the corpus."""
    every = stored(contexts(found, text_col, reach), "contexts")
    total = every.groupBy("term").agg(F.count_distinct("copy").alias("n_near"))
    count = every.groupBy("entity", "term").agg(F.count_distinct("ctx").alias("n_ctx"), F.count_distinct("copy").alias("n"))
    # common words stand near many entities: most fall here, before the corpus is asked. n_near is at most the number of texts with
    # the term, so no pair is lost that could reach the posterior
    pair = stored(count.where(F.col("n_ctx") >= support).join(total, "term").where(F.col("n") >= posterior * F.col("n_near")), "candidates")
    if pair.isEmpty():
        return pair.select("term")
    cand = pair.select("term").distinct()
    small = fits_broadcast(cand, 200_000)
    all_terms = docs.select(F.explode(F.array_distinct(tokens(F.coalesce(F.col(text_col), F.lit(""))))).alias("term"), F.xxhash64(text_col).alias("copy"))
    n_term = all_terms.join(F.broadcast(cand) if small else cand, "term", "left_semi").distinct().groupBy("term").agg(F.count("*").alias("n_term"))
    n_all = docs.select(F.xxhash64(text_col)).distinct().count()
    n_entity = mentions(found, text_col).groupBy("entity").agg(F.count_distinct("copy").alias("n_entity"))
    p = F.col("n") / F.greatest("n_term", "n_near")
    return pair.join(n_term, "term").join(n_entity, "entity").where((p >= posterior) & (F.log2(p * n_all / F.col("n_entity")) >= bits)).select("term").distinct()


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 8, support: int = 2, posterior: float = 0.8, bits: float = 6.0, most_terms: int = 100_000) -> DataFrame:
    """docs with pii_base, pii_spans (base and term spans, by kind, then start) and pii_text (the sanitised text) added (under the names
    that names_in() gives).

    The disclosing terms are looked up in the words of every text; places are made in the texts that hold one."""
    columns = docs.columns
    docs = docs.toDF(*(f"in{i}" for i in range(len(columns))))  # names of the input can't clash with ours
    id_col, text_col = (f"in{columns.index(c)}" for c in (id_col, text_col))
    base = with_spans(docs.select(id_col, text_col), text_col)
    found = stored(base.where(F.size("pii_base") > 0).select(text_col, "pii_base"), "entities")
    bad = stored(disclosing(docs, found, text_col, reach, support, posterior, bits), "terms")
    out = with_spans(docs, text_col)
    drop_stored(found)
    if bad.isEmpty():
        out = out.withColumn("pii_term", none())
    else:
        text = F.coalesce(F.col(text_col), F.lit(""))
        each = docs.select(F.xxhash64(text_col).alias("pii_key"), F.explode(F.array_distinct(tokens(text))).alias("term"))
        each = stored(each.join(F.broadcast(bad) if fits_broadcast(bad, most_terms) else bad, "term", "left_semi").distinct(), "hits")
        held = each.groupBy("pii_key").agg(F.collect_list("term").alias("pii_held"))
        if fits_broadcast(each, most_terms):  # few: the texts stay where they are
            held = F.broadcast(held)
        out = out.withColumn("pii_key", F.xxhash64(text_col)).join(held, "pii_key", "left").drop("pii_key")
        out = out.withColumn("pii_term", F.when(F.col("pii_held").isNotNull(), places(text, F.col("pii_held"))).otherwise(none())).drop("pii_held")
    inside = F.filter("pii_term", lambda x: ~F.exists("pii_base", lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])))
    out = out.withColumn("pii_spans", F.concat("pii_base", inside)).drop("pii_term")
    out = out.withColumn("pii_text", F.when(F.size("pii_spans") > 0, replaced(F.col(text_col), F.col("pii_spans"))).otherwise(F.col(text_col)))
    return out.select(*(F.col(f"in{i}").alias(c) for i, c in enumerate(columns)), *(F.col(c).alias(x) for c, x in zip(ADDED, names_in(columns), strict=True)))


ADDED = ("pii_base", "pii_spans", "pii_text")


def names_in(columns: list[str]) -> list[str]:
    """The names of the columns that sanitise() adds to these."""
    return [unused(c, columns) for c in ADDED]


def replaced(text: Column, spans: Column) -> Column:
    """text with [EMAIL], [IP], [CARD], [PHONE] in place of spans; terms go to [NUMBER] if they hold digits, else to [REMOVED]."""
    order = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    name = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("s"))

    def step(acc: Column, x: Column) -> Column:
        own = F.substring(text, x["start"] + 1, x["end"] - x["start"])
        label = F.when(x["kind"] < 4, F.get(name, x["kind"])).when(own.rlike("[0-9]"), "[NUMBER]").otherwise("[REMOVED]")
        more = F.concat(acc["s"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), label)
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] >= acc["at"], more).otherwise(acc["s"]).alias("s"))

    end = F.aggregate(order, zero, step)
    return F.concat(end["s"], F.substring(text, end["at"] + 1, F.length(text)))


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = F.array(*(F.lit(k) for k in (*KINDS, "term")))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def count_kind(kind: int) -> Column:
    return F.size(F.filter("pii_base", lambda x: x["kind"] == kind)).cast("long")
