"""Benchmark decontamination with a distributed positional inverted index.

Words are runs of characters outside [\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F], A-Z lower-cased. A window is `size` consecutive words of a test
item; an item of fewer words, but not none, is one window.

1. The terms of all windows are counted over all documents; each window gets its `RAREST` rarest places.
2. The index holds the postings of these terms in the documents: term, text, sorted positions. It is stored, dealt by text and term.
3. For each window and text, the list of the rarest term is shifted by the term's place in the window, and intersected with the shifted
   lists of the next rarest ones. What is left are places where the window can begin.
4. Only texts that have such places are read again: the window is compared with the text word by word.

A proximity match (with `slack`) has every word of a window within `slack` words of its place, in any order, places being counted from an
occurrence of the rarest word; lists are intersected with that tolerance. It covers the window's places, cut at the ends of the text.

DataFrame functions only. Windows of the test items are broadcast while they are at most `broadcast_windows` and BROADCAST_BYTES, and
joined by shuffles beyond that; the path is the same. Hits belong to texts (told apart by their MD5), so rows are judged by their own
text: null and repeated ids are as good as others, and repeated rows give repeated results. Null and empty texts have no words, texts are
read whole however long they are, equal windows of an item count once, and items of equal text (ties) are all listed. Only the named
columns are read, others may clash. Empty tables give empty results, or zero hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import drop_stored, lower_ascii, stored

# fixed values: what separates words, and words before lower-casing
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RAREST = 2  # places of a window whose terms are indexed; a third one is mostly a frequent term with long lists
BROADCAST_BYTES = 64 << 20


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATOR), "")


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def item_windows(items: DataFrame, item_col: str, text_col: str, size: int) -> DataFrame:
    """(item, win, terms): the distinct windows of each item, with a key."""
    w = items.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - size + 1))
    each = w.select("item", "w", F.explode(starts).alias("i")).select("item", F.slice("w", F.col("i"), size).alias("terms")).distinct()
    return each.select("item", F.unhex(F.md5(F.array_join("terms", " "))).alias("win"), "terms")  # no term holds a space


def few(df: DataFrame, rows: int, size: Column) -> bool:
    """True if df has at most so many rows and BROADCAST_BYTES."""
    got = df.agg(F.count("*").alias("n"), F.sum(size).alias("b")).first()
    return got["n"] <= rows and (got["b"] or 0) <= BROADCAST_BYTES


class Plan:
    """The windows with their rarest places, and the items that have them, as stored tables."""

    def __init__(self, docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = 10, broadcast_windows: int = 200_000):
        self.items = stored(item_windows(items, item_col, item_text, size), "items")
        distinct = self.items.groupBy("win").agg(F.any_value("terms").alias("terms"))
        self.most = broadcast_windows
        self.small = few(self.items, broadcast_windows, F.octet_length(F.array_join("terms", " ")))
        # one row for each place of a window; at most `size` a window, so they fit if windows do
        place = distinct.select("win", "terms", F.posexplode("terms").alias("at", "term"))
        n = term_counts(docs, text_col, place.select("term").distinct(), self)
        order = F.transform(F.array_sort(F.collect_list(F.struct("n", "at", "term"))), lambda x: F.struct(x["at"].alias("at"), x["term"].alias("term")))
        rows = place.join(self.held(n), "term").groupBy("win").agg(F.any_value("terms").alias("terms"), F.slice(order, 1, RAREST).alias("rare"))
        self.windows = stored(rows, "windows")

    def held(self, df: DataFrame) -> DataFrame:
        """df as a side of a join: broadcast if the windows are few."""
        return F.broadcast(df) if self.small else df

    def drop(self) -> None:
        drop_stored(self.items, self.windows)


def term_counts(docs: DataFrame, text_col: str, terms: DataFrame, plan: Plan) -> DataFrame:
    """(term, n): occurrences of the terms over all documents; terms that never occur have 0."""
    rows = docs.select(F.explode(words(F.col(text_col))).alias("term"))
    n = rows.join(plan.held(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    return terms.join(plan.held(n), "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def index(docs: DataFrame, plan: Plan, text_col: str = "text") -> DataFrame:
    """(key, term, positions): the stored postings of the windows' rarest terms. Equal texts have one list."""
    terms = plan.windows.select(F.explode("rare.term").alias("term")).distinct()
    rows = docs.select(text_key(F.col(text_col)).alias("key"), F.posexplode(words(F.col(text_col))).alias("pos", "term"))
    rows = rows.join(plan.held(terms), "term", "left_semi")
    return stored(rows.groupBy("key", "term").agg(F.sort_array(F.collect_set("pos")).alias("positions")), "postings")


def places(postings: DataFrame, plan: Plan, slack: int = 0) -> DataFrame:
    """(key, win, starts): where windows can begin, from the intersection of shifted lists. With slack, lists but the rarest are widened."""
    w = plan.windows.select("win", "rare")
    first = F.element_at("rare", F.lit(1))
    one = postings.join(plan.held(w.withColumn("term", first["term"])), "term")
    one = one.select("key", "win", "rare", F.transform("positions", lambda p: p - F.element_at("rare", F.lit(1))["at"]).alias("starts"))
    for r in range(1, RAREST):
        there = F.size("rare") > r
        at = F.get("rare", F.lit(r))["at"]
        own = one.withColumn("term", F.get("rare", F.lit(r))["term"]).join(postings, ["key", "term"], "left")
        shifted = F.transform("positions", lambda p: p - at)  # noqa: B023
        if slack:
            shifted = F.flatten(F.transform(shifted, lambda s: F.sequence(s - slack, s + slack)))
        starts = F.when(there, F.array_intersect("starts", F.coalesce(shifted, F.array().cast("array<int>")))).otherwise(F.col("starts"))
        one = own.select("key", "win", "rare", starts.alias("starts")).where(F.size("starts") > 0)
    return one.select("key", "win", "starts")


def matches(docs: DataFrame, plan: Plan, text_col: str = "text", slack: int | None = None) -> DataFrame:
    """(key, win, start, length), stored: exact phrase matches of the planned windows (with slack: proximity matches), by text key."""
    postings = index(docs, plan, text_col)
    found = places(postings, plan, slack or 0).join(plan.held(plan.windows.select("win", "terms")), "win")
    found = stored(found.groupBy("key").agg(F.collect_list(F.struct("win", "terms", "starts")).alias("found")), "places")
    drop_stored(postings)
    held = F.broadcast(found) if few(found, plan.most, F.aggregate("found", F.lit(0), lambda a, x: a + 4 * F.size(x["starts"]) + F.octet_length(F.array_join(x["terms"], " ")))) else found
    rows = docs.select(text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text")).join(held, "key")
    rows = rows.select("key", words(F.col("text")).alias("w"), F.explode("found").alias("x")).select("key", "w", "x.win", "x.terms", F.explode("x.starts").alias("start"))
    n = F.size("terms")
    if slack is None:
        rows = rows.where((F.col("start") >= 0) & (F.col("start") + n <= F.size("w"))).where(F.slice("w", F.col("start") + 1, n) == F.col("terms"))
        rows = rows.select("key", "win", "start", n.alias("length"))
    else:
        low, end = F.greatest(F.lit(0), F.col("start") - slack), F.least(F.size("w"), F.col("start") + n + slack)
        near = rows.select("key", "win", "terms", "start", F.size("w").alias("all"), low.alias("low"), F.slice("w", low + 1, end - low).alias("near"))
        first = lambda i: F.greatest(F.lit(0), F.col("start") + i - slack - F.col("low"))
        last = lambda i: F.col("start") + i + slack - F.col("low")
        inside = F.forall(F.transform("terms", lambda t, i: F.array_contains(F.slice("near", first(i) + 1, F.greatest(F.lit(0), last(i) - first(i) + 1)), t)), lambda x: x)
        begin = F.greatest(F.lit(0), F.col("start"))
        rows = near.where(inside).select("key", "win", begin.alias("start"), (F.least(F.col("all"), F.col("start") + n) - begin).alias("length"))
    out = stored(rows.distinct(), "hits")
    drop_stored(found)
    return out


def covered(spans: Column) -> Column:
    """The number of places inside a sorted array of (start, length)."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["start"] + x["length"] - F.greatest(acc["end"], x["start"]))).alias("n"), F.greatest(acc["end"], x["start"] + x["length"]).alias("end"))
    return F.aggregate(spans, zero, step)["n"]


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = 10, slack: int | None = None, broadcast_windows: int = 200_000) -> DataFrame:
    """One row per row of docs: id, n_words, n_hit (words inside a window), n_items, items (sorted array of strings), contaminated."""
    plan = Plan(docs, items, text_col, item_col, item_text, size, broadcast_windows)
    found = matches(docs, plan, text_col, slack)
    spans = found.groupBy("key").agg(covered(F.array_sort(F.collect_set(F.struct("start", "length")))).cast("long").alias("n_hit"))
    listed = found.select("key", "win").distinct().join(plan.held(plan.items.select("win", "item")), "win").groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    per_text = stored(spans.join(listed, "key"), "texts")
    drop_stored(found)
    plan.drop()
    if few(per_text, plan.most, F.octet_length(F.array_join("items", " "))):
        per_text = F.broadcast(per_text)
    n_words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD))
    base = docs.select(F.col(id_col), text_key(F.col(text_col)).alias("key"), n_words.cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return base.join(per_text, "key", "left").select(
        F.col(id_col), "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n_hit > 0).alias("contaminated")
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", size: int = 10, broadcast_windows: int = 200_000) -> DataFrame:
    """docs without the rows whose texts hold a window of an item; columns as they were."""
    plan = Plan(docs, items, text_col, size=size, broadcast_windows=broadcast_windows)
    found = matches(docs, plan, text_col)
    plan.drop()
    leaks = stored(found.select(F.col("key").alias("leak_key")).distinct(), "leaks")
    drop_stored(found)
    leaks = F.broadcast(leaks) if few(leaks, plan.most, F.lit(16)) else leaks
    return docs.join(leaks, text_key(docs[text_col]) == leaks["leak_key"], "left_anti")
