"""A training-data pipeline of five stages over documents, each written and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from easel.llm import mixing, pieces, queries, shared, simhash, substrings, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labels of these documents, doesn't predict toxic: rows go by their own
    text, null ids too; without labels all stay, as do columns of any names. Very long texts are scored whole. An empty
    table stays empty."""
    return toxicity.clean_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each SimHash group, null ids last, one row of several equal ones. Texts
    without words are a group. Very long texts are read whole. Columns stay, of any names. An empty table stays empty."""
    return simhash.keep_first(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words that a document of a smaller id has; emptied ones go. Rows with a null id
    neither lose words nor take any; rows of one id don't take words from each other. Very long texts are cut whole.
    Columns stay, of any names. An empty table stays empty."""
    return substrings.kept_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a row for each full pass over a document, one for a partial pass. A null source
    is one, null and empty texts give no row, a null id is an id, and each row takes by itself whatever ids and texts
    repeat. Very long texts are rows as any. Columns stay, of any names. An empty table stays empty."""
    return mixing.mixed_documents(docs)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids, of the text they decode to and of the pieces' ends, a row for each row of the
    mix; null ids stay. Very long texts are encoded whole. Other columns, of whatever names, go. An empty table gives an
    empty result."""
    return queries.digests(pieces.encode_pieces(docs, queries.tokenizer_path("piece_bpe_32k.model")))


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_copies), ("substrings", cut_repeats), ("mixing", mix), ("sentencepiece", to_pieces)]

#: No SQL states the classifier's or the fingerprints' decisions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's own tables, and what it read, are deleted once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        with shared.scratch():
            after = stage(spark, docs, sf_dir)
            after = shared.stage(after, name, keep=True)
        if k:
            shared.unstage(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
