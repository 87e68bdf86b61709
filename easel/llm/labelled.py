"""The bounded sample of labelled documents that classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fold, text_bytes


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, doc_id: str = "doc_id", text: str = "text", folds: int = 5, held_out: int = 0) -> DataFrame:
    """(doc_id, text, label): at most `most` rows, one for each of the ids of the lowest seeded hashes out of all whose
    id's crc32 doesn't leave held_out modulo folds. An id with several labels has their largest; one with several
    texts has the text of the lowest hash. Null labels and ids, and labels other than 0 and 1, are left out; so are ids
    without a document. Whole texts."""
    rows = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("label")).where("_id is not null and label in (0, 1)")
    rows = rows.where(fold("_id", folds) != held_out).groupBy("_id").agg(F.max("label").alias("label"))
    few = rows.orderBy(F.xxhash64(F.lit(11), "_id"), "_id").limit(most)
    # at most `most` rows of two numbers, so they are sent to every task
    found = docs.select(F.col(doc_id).alias("doc_id"), text_bytes(text).alias("text")).join(F.broadcast(few), F.col("doc_id") == F.col("_id"))
    return found.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("doc_id", "text", "label")
