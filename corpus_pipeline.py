"""The corpus pipeline over documents: toxicity, near duplicates, benchmark decontamination, PII, mixing to target weights.

Each stage works on all rows that the one before kept. All but the last return the columns of documents. Null and empty texts pass every
filter (mixing may leave them out or repeat them, as their rates say); rows with a null id pass near_duplicates, which goes by ids. Repeated rows are
judged alike, ties go to the smaller id, texts are read whole. Other columns come along; columns that mixing adds get an underscore more where
documents has their name. Empty tables give empty results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.llm import decontam, mixing, neardup, pii, toxicity
from lexspan.llm._common import fits_broadcast, read, stored, unused

#: shares of tokens of documents of high and low quality
TARGETS = {"1": 0.95, "0": 0.05}
#: ids of rows to drop are broadcast up to this number (8 MB), and joined by a shuffle beyond it
MOST_IDS = 1_000_000


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in ids (a column drop_id); rows with a null id stay."""
    return docs.join(F.broadcast(ids) if fits_broadcast(ids, MOST_IDS) else ids, docs["doc_id"] == ids["drop_id"], "left_anti")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model rejects go, by the cut that it has from held-out folds of the labels; null and empty texts stay."""
    return toxicity.drop_toxic(docs, toxicity.fit_toxicity(docs, read(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id (rows that repeat an id stay together)."""
    groups = neardup.near_duplicates(docs.select("doc_id", "text"), k=5, percent=80)
    return without(docs, stored(groups.where("not kept").select(F.col("doc_id").alias("drop_id")), "copies"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten successive words of a benchmark item, or a whole shorter item, go."""
    return decontam.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that disclose it are replaced in the text; n_chars follows."""
    found = pii.sanitise(docs)
    _, spans, text = pii.names_in(docs.columns)
    changed = F.size(spans) > 0
    return found.select(*(F.when(changed, F.length(text).cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(text).alias(c) if c == "text" else F.col(c) for c in docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: each document as often as its rate says (chance decides on the fraction), so that the expected tokens of each quality have
    the target shares. Adds n_tokens, rate and copy (a number from 1)."""
    mixed = mixing.mix(docs, read(spark, sf_dir, "labels"), F.col("quality").cast("string"), TARGETS)
    tokens, posterior, _, copies = mixing.names_in(docs.columns)
    out = mixing.taken(mixed.drop(posterior), copies)
    for old, new in ((tokens, "n_tokens"), (copies, "copy")):
        out = out.withColumnRenamed(old, unused(new, docs.columns))
    return out


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("decontamination", decontaminate), ("pii", sanitise), ("mixing", mix)]
#: classifiers, near duplicates and fitted rates have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs
