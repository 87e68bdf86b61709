"""Quality rules: a threshold table compiled into Spark projections, without user functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE

# Common function words of English, German, Spanish and French.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not he this are or his from at which an "
    "der die das und ist von mit den für ein eine im auf zu nicht auch sich dem "
    "el la los las de que y en un una es por con para se del no su "
    "le les des et est dans pour que qui pas au sur une du par plus ce il"
).split()

#: (name, numerator, denominator, low, high): a document fails where the ratio leaves [low, high]; an
#: empty denominator makes the ratio 0. Bounds of None are open.
RULES = (
    ("mean_word_length", "word_chars", "n_words", 1.5, 25.0),
    ("symbols_per_word", "n_symbols", "n_words", None, 0.25),
    ("stop_words_per_word", "n_stop_words", "n_words", 0.01, None),
    ("duplicate_lines", "n_dup_lines", "n_lines", None, 0.5),
    ("shouted_words", "n_shouted", "n_words", None, 0.5),
    ("repeated_words", "n_repeat_words", "n_words", None, 0.3),
)


def _measures(df: DataFrame, text: str) -> DataFrame:
    """Adds the counts that the rules read, each stage one projection over the one before."""
    t = F.coalesce(F.col(text), F.lit(""))
    symbol_free = t
    for c in "#*$%&|<>":
        symbol_free = F.replace(symbol_free, F.lit(c), F.lit(""))
    df = df.withColumns({
        "_w": F.filter(F.split(t, SPACE + "+"), lambda w: w != ""),
        "_lines": F.transform(F.filter(F.split(t, "\n"), lambda x: F.trim(x, F.lit(" \t\n\x0b\x0c\r")) != ""), lambda x: F.xxhash64(x)),
        "n_symbols": (F.length(t) - F.length(symbol_free)).cast("long"),
    })
    df = df.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_stop_words": F.size(F.filter("_w", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long"),
        "n_shouted": F.size(F.filter("_w", lambda w: (F.length(w) > 1) & (w == F.upper(w)) & (w != F.lower(w)))).cast("long"),
        "_h": F.transform("_w", lambda w: F.xxhash64(w)),
    })
    # the hash of 8 words from hashes of 2, 4: each level pairs a position with the one 1, 2, 4 further on
    for k in (1, 2, 4):
        n = F.greatest(F.size("_h") - k, F.lit(0))
        df = df.withColumn("_h", F.zip_with(F.slice("_h", F.lit(1), n), F.slice("_h", F.lit(k + 1), n), lambda a, b: F.xxhash64(a, b)))
    # only texts with a window that recurs go on to find its places, by sorting
    df = df.withColumn("_at", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    m = F.size("_at")
    df = df.withColumn("_same", F.zip_with(F.slice("_at", F.lit(1), m - 1), F.slice("_at", F.lit(2), m - 1), lambda a, b: a["h"] == b["h"]))
    no = F.array(F.lit(False))
    twice = F.zip_with(F.concat(no, "_same"), F.concat("_same", no), lambda a, b: a | b)
    df = df.withColumn("_at", F.array_sort(F.transform(F.filter(F.zip_with("_at", twice, lambda a, b: F.struct(a["i"].alias("i"), b.alias("x"))), lambda s: s["x"]), lambda s: s["i"])))
    n = F.size("_at")
    gaps = F.zip_with(F.slice("_at", F.lit(1), n - 1), F.slice("_at", F.lit(2), n - 1), lambda a, b: F.least(b - a, F.lit(8)))
    df = df.withColumn("n_repeat_words", F.when(F.col("_at").isNull(), F.lit(0)).otherwise(F.aggregate(gaps, F.lit(8), lambda s, g: s + g)).cast("long"))
    return df.drop("_w", "_lines", "_h", "_at", "_same")


def compile_rules(rules=RULES) -> Column:
    """One boolean expression from the table: whether a row breaks any rule."""
    broken = F.lit(False)
    for _, top, bottom, low, high in rules:
        ratio = F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))
        if low is not None:
            broken = broken | (ratio < low)
        if high is not None:
            broken = broken | (ratio > high)
    return broken


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules=RULES, min_words: int = 20) -> DataFrame:
    """Counts, the base rule and the verdict for each row.

    A null or empty text has no words, fails the base rule and isn't kept. Rows stand alone: repeated rows
    and null ids get a row each, and a very long text is counted whole in its row. An empty table gives an empty result.
    Other columns of docs aren't read.
    """
    df = _measures(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text").drop("text")
    df = df.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    return df.withColumn("kept", ~F.col("base_failed") & ~compile_rules(rules)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words", "n_shouted")
