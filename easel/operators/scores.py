"""Decisions from model scores, which arrive as tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from easel.functions.rasters import let
from easel.plans.ship import ship

from .tags import with_position

# The weight of each aesthetic label, best first.
AESTHETIC = {"masterpiece": 10.0, "best": 8.6, "great": 7.4, "good": 6.1, "normal": 4.6, "low": 2.4, "worst": 0.0}
# Tag categories.
CHARACTER, RATING, COPYRIGHT, META, MODEL, QUALITY = 4, 9, 3, 5, 7, 8


def batch_score(df: DataFrame, make_predict: Callable[[], Callable[[np.ndarray], np.ndarray]], id: str = "id", feature: str = "feature", batch: int = 16) -> DataFrame:
    """(id, scores, ok, error): a model built once per task scores batches; where a batch fails its rows are scored
    alone, and a row that fails keeps its error. Null features are errors."""
    ship(df.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = make_predict()
        for f in frames:
            out: list = []
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch]
                try:
                    out += [(list(map(float, s)), True, None) for s in predict(np.stack(list(part[feature])))]
                except Exception:
                    for x in part[feature]:
                        try:
                            out.append((list(map(float, predict(np.stack([x]))[0])), True, None))
                        except Exception as e:
                            out.append((None, False, str(e) or type(e).__name__))
            yield pd.DataFrame({id: f[id], "scores": [o[0] for o in out], "ok": [o[1] for o in out], "error": [o[2] for o in out]})

    kind = df.schema[id].dataType.simpleString()
    return df.select(id, feature).mapInPandas(run, f"{id} {kind}, scores array<double>, ok boolean, error string")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), x))))


def select_tags(scores: DataFrame, vocab: DataFrame, general: float = 0.35, character: float = 0.85, keep_copyright: bool = True, keep_meta: bool = False, keep_model: bool = False, keep_quality: bool = False, id: str = "id", probs: str = "probs") -> DataFrame:
    """(id, general, character, rating): lists of {name, confidence}, surest first, ties in vocabulary order.

    vocab: (idx, name, category). Ratings have no threshold, characters theirs, all else the general one; copyright,
    meta, model and quality tags only with their flags. Raw scores are compared, then rounded to 4 digits. The
    vocabulary is one model's output layer, a few thousand names; Spark broadcasts it where its size allows.
    """
    left_out = [c for c, keep in ((COPYRIGHT, keep_copyright), (META, keep_meta), (MODEL, keep_model), (QUALITY, keep_quality)) if not keep]
    rows = scores.select(id, F.posexplode(probs).alias("idx", "p")).join(vocab, "idx")
    kind = (
        F.when(F.col("category") == RATING, "rating")
        .when(F.col("category") == CHARACTER, F.when(F.col("p") >= character, "character"))
        .when((F.col("p") >= general) & ~F.col("category").isin(*left_out), "general")
    )
    rows = rows.withColumn("kind", kind).where("kind is not null").withColumn("_s", F.struct((-F.round("p", 4)).alias("neg"), "idx", "name"))
    lists = [F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("_s")))), lambda s: F.struct(s["name"].alias("name"), (-s["neg"]).alias("confidence"))).alias(k) for k in ("general", "character", "rating")]
    found = rows.groupBy(F.col(id).alias("_i")).agg(*lists)
    none = F.array().cast("array<struct<name:string,confidence:double>>")
    return scores.select(id).join(found, F.col(id) == F.col("_i"), "left").select(id, *[F.coalesce(k, none).alias(k) for k in ("general", "character", "rating")])


def tag_string(keep_rating: bool = False) -> Column:
    """Characters, then generals, then the top rating if kept; ', ' between, _ shown as a space."""
    names = lambda c: F.transform(c, lambda t: t["name"])
    parts = [names(F.col("character")), names(F.col("general"))]
    if keep_rating:
        parts.append(names(F.slice("rating", 1, 1)))
    return F.replace(F.array_join(F.concat(*parts), ", "), F.lit("_"), F.lit(" "))


def top_label(labels: Column, probs: Column) -> Column:
    """{label, confidence} of the largest score, the first of ties; empty gives '' and 0."""
    best = let(F.array_max(probs), lambda m: F.struct(F.element_at(labels, F.array_position(probs, m).cast("int")).alias("label"), m.alias("confidence")))
    return F.when(F.size(probs) > 0, best).otherwise(F.struct(F.lit("").alias("label"), F.lit(0.0).alias("confidence")))


def aesthetic_score(labels: Column, probs: Column) -> Column:
    """The mean label weight by score, 3 decimals; labels without a weight don't count, no weight at all gives 0."""
    weight = F.create_map(*[F.lit(x) for kv in AESTHETIC.items() for x in kv])
    known = F.filter(F.arrays_zip(labels.alias("l"), probs.alias("p")), lambda z: F.array_contains(F.map_keys(weight), z["l"]))
    total = F.aggregate(known, F.lit(0.0), lambda s, z: s + z["p"])
    return F.when(total > 0, F.round(F.aggregate(known, F.lit(0.0), lambda s, z: s + z["p"] * F.element_at(weight, z["l"])) / total, 3)).otherwise(F.lit(0.0))


def class_gate(df: DataFrame, allowed: list[str], threshold: float, margin: float = 0.18, relaxed: bool = True, labels: str = "labels", probs: str = "probs", aesthetic_label: str = "aesthetic_label", score: str = "score") -> DataFrame:
    """Adds raw_class_label, raw_class_confidence (the top class), class_label, class_confidence (the class that counts,
    6 digits), passed and fallback.

    With no allowed class all pass. Else the top class must be allowed and sure enough; relaxed, the best allowed class
    passes in its place: by margin if it is close behind the top, by aesthetics if label and score are good.
    """
    top = top_label(F.col(labels), F.col(probs))
    some = F.filter(F.arrays_zip(F.col(labels).alias("l"), F.col(probs).alias("p")), lambda z: z["l"].isin(allowed))
    best = top_label(F.transform(some, lambda z: z["l"]), F.transform(some, lambda z: z["p"]))
    df = df.withColumns({"_t": top, "_a": best})
    sure, a = F.col("_t.confidence"), F.col("_a.confidence")
    direct = F.col("_t.label").isin(allowed) & (sure >= threshold) if allowed else F.lit(True)
    any_allowed = F.lit(relaxed) & (F.col("_a.label") != "")
    by_margin = any_allowed & (sure - a <= margin) & (a >= max(threshold, 0.08))
    by_looks = any_allowed & (a >= max(threshold, 0.05)) & ~F.col(aesthetic_label).isin("low", "worst") & (F.col(score) >= 4.3)
    df = df.withColumn("fallback", F.when(direct, "").when(by_margin, "margin").when(by_looks, "aesthetic").otherwise(""))
    other = F.col("fallback") != ""
    return df.withColumns({
        "raw_class_label": F.col("_t.label"),
        "raw_class_confidence": F.round(sure, 6),
        "class_label": F.when(other, F.col("_a.label")).otherwise(F.col("_t.label")),
        "class_confidence": F.round(F.when(other, a).otherwise(sure), 6),
        "passed": direct | other,
    }).drop("_t", "_a")


def score_gate(df: DataFrame, min_score: float, score_only_passed: bool = False, score: str = "score", passed: str = "passed", label: str = "aesthetic_label") -> DataFrame:
    """Blanks the score of rejected rows, and their label if that column is there, on request; adds low: a score below
    the minimum (held within 0 and 10)."""
    if score_only_passed:
        df = df.withColumn(score, F.when(F.col(passed), F.col(score)))
        if label in df.columns:
            df = df.withColumn(label, F.when(F.col(passed), F.col(label)).otherwise(""))
    return df.withColumn("low", F.coalesce(F.col(score) < max(0.0, min(10.0, min_score)), F.lit(False)))


def score_summary(df: DataFrame) -> DataFrame:
    """One row: total ok, scored, rejected, low and the mean score, from ok, score, passed and low."""
    ok = F.col("ok")
    return df.agg(F.count_if(ok).alias("total"), F.count_if(ok & F.col("score").isNotNull()).alias("scored"), F.count_if(ok & ~F.col("passed")).alias("rejected"), F.count_if(ok & F.col("low")).alias("low"), F.avg(F.when(ok, F.col("score"))).alias("mean_score"))


def review_rank() -> Column:
    """Low but passed 0, rejected 1, passed 2, error 3, not scored 4."""
    return F.when(F.col("ok").isNull(), 4).when(~F.col("ok"), 3).when(~F.col("passed"), 1).when(F.col("low"), 0).otherwise(2)


def review_order(df: DataFrame, pos: str = "pos") -> DataFrame:
    return df.orderBy(review_rank(), F.coalesce("score", F.lit(99.0)), pos)


def keep_passed(df: DataFrame, min_score: float, gated: bool = True) -> DataFrame:
    ok = F.col("ok") & F.col("score").isNotNull() & (F.col("score") >= min_score)
    return df.where(ok & F.col("passed") if gated else ok)


def low_files(df: DataFrame, min_score: float, gated: bool = True) -> DataFrame:
    """What keep_passed() leaves out."""
    ok = F.col("ok") & F.col("score").isNotNull() & (F.col("score") >= min_score)
    return df.where(~F.coalesce(ok & F.col("passed") if gated else ok, F.lit(False)))


def format_score_text() -> Column:
    """One line a row from ok, error, score, aesthetic_label, class_label, class_confidence, passed, low, fallback and
    raw_class_label: a dash for what is missing, then only what is out of the ordinary."""
    dash = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("-"))
    named = lambda k, c: F.concat(F.lit(f"{k}:"), F.nullif(F.col(c), F.lit("")))
    text = F.concat_ws(
        ", ",
        F.concat(F.lit("score:"), F.when(F.col("score").isNull(), "-").otherwise(F.format_string("%.2f", F.col("score")))),
        F.concat(F.lit("quality:"), dash("aesthetic_label")),
        F.concat(F.lit("class:"), dash("class_label")),
        F.concat(F.lit("class_conf:"), F.floor(F.col("class_confidence") * 100 + 0.5).cast("string"), F.lit("%")),
        F.when(~F.col("passed"), "class_passed:no"),
        F.when(F.col("low"), "low_score:yes"),
        named("fallback", "fallback"),
        F.when(F.col("raw_class_label") != F.col("class_label"), named("raw_class", "raw_class_label")),
    )
    return F.when(F.col("ok"), text).otherwise(F.concat(F.lit("error: "), F.coalesce(F.nullif(F.col("error"), F.lit("")), F.lit("failed"))))


def ranked(df: DataFrame, pos: str = "pos") -> DataFrame:
    """Adds place: the row's place in review_order(), which should not tie."""
    return with_position(df, [review_rank(), F.coalesce("score", F.lit(99.0)), F.col(pos)], "place")
