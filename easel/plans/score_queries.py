"""Queries for clusters and model scores; the 64 vector components serve as scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from easel.functions import rasters as R
from easel.operators import clusters as K
from easel.operators import scores as M

from .tables import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


_V = "v as (select vec_id id, label, list_transform(embedding, lambda x: x::double) e from embeddings)"
_LABELS = list(M.AESTHETIC) + ["other"]


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))


@query(f"with {_V}, n as (select *, sqrt(list_dot_product(e, e)) n from v) select id, list_transform(e, lambda x: x / case when n = 0 then 1 else n end) unit from n")
def k1_l2_normalize(spark, d):
    return _vectors(spark, d).select("id", R.l2_normalize(F.col("e")).alias("unit"))


@query(f"""with {_V}, p as (select id, label, e[1:16] a, e[17:64] b from v), w as (select id, list_concat(list_transform(a, lambda x: x / sqrt(list_dot_product(a, a)) * 0.7::double), list_transform(b, lambda x: x / sqrt(list_dot_product(b, b)) * 0.3::double)) f from p where label != 3),
 u as (select id, list_transform(f, lambda x: round(x / sqrt(list_dot_product(f, f)), 12)) feature from w) select v.id, u.feature from v left join u on u.id = v.id""")
def k2_fuse_features(spark, d):
    v = _vectors(spark, d)
    part = lambda a, n: v.select("id", "label", F.slice("e", a, n).alias("feature"))
    fused = K.fuse_features({"style": (part(1, 16), 0.7), "semantic": (part(17, 48).where("label != 3"), 0.3), "color": (part(1, 4), 0.0)})
    return fused.withColumn("feature", F.transform("feature", lambda x: R.round_scaled(x, 12)))


@query()
def k3_kmeans(spark, d):
    return K.kmeans(_vectors(spark, d).withColumnRenamed("e", "feature"), 10)


@query()
def k4_pca(spark, d):
    return K.pca(_vectors(spark, d).withColumnRenamed("e", "feature"), 8)


@query()
def k5_density_cluster(spark, d):
    return K.density_cluster(_vectors(spark, d).withColumnRenamed("e", "feature"), 40, dims=10)


@query("select count(distinct label % 4) group_count from embeddings")
def k6_cluster_report(spark, d):
    v = _vectors(spark, d)
    return K.cluster_report(v.select("id"), v.select("id", (F.col("label") % 4).alias("group")))[1]


_FAILS = "case when id % 17 = 5 then 'no model input' end"
_PARTS = ", ".join(f"list_sum([{', '.join(f'e[{i + 1}] * {(i * (k + 3) % 11 - 5) / 8!r}::double' for i in range(64))}])" for k in range(4))


@query(f"with {_V}, s as (select id, e, id % 17 = 5 bad, [{_PARTS}] p from v) select id, case when not bad then list_transform(p, lambda x: round(x, 9)) end scores, not bad ok, {_FAILS} error from s")
def m1_batch_score(spark, d):
    """A linear model that fails on marked rows: a batch that holds one is scored row by row."""

    def make():
        import numpy as np

        w = np.array([[(i * (k + 3) % 11 - 5) / 8 for k in range(4)] for i in range(64)])

        def predict(x):
            if (x[:, 64] == 5).any():
                raise ValueError("no model input")
            return x[:, :64] @ w

        return predict

    marked = _vectors(spark, d).withColumn("e", F.concat("e", F.array((F.col("id") % 17).cast("double"))))
    return M.batch_score(marked, make, feature="e").withColumn("scores", F.transform("scores", lambda x: F.round(x, 9)))


@query(f"with {_V} select id, list_transform(e, lambda x: round(1 / (1 + exp(-greatest(-50, least(50, x * 400)))), 12)) p from v")
def m2_sigmoid(spark, d):
    return _vectors(spark, d).select("id", F.transform("e", lambda x: R.round_scaled(M.sigmoid(x * 400), 12)).alias("p"))


#: Names and categories of the 64 components as a vocabulary.
_VOCAB = "vocab as (select i::int idx, concat('tag_', i) as name, case when i % 16 = 9 then 9 when i % 8 = 4 then 4 when i % 7 = 3 then 3 when i % 11 = 5 then 5 when i % 13 = 1 then 8 else 0 end category from range(64) r(i))"
_PICK = f"""{_V}, {_VOCAB}, p as (select v.id, idx, name, category, e[idx + 1] + 0.3 p from v, vocab),
 k as (select *, case when category = 9 then 'rating' when category = 4 then case when p >= 0.5 then 'character' end when category in (5, 7, 8) then null when p >= 0.35 then 'general' end kind from p),
 l as (select id, kind, list(name order by round(p, 4) desc, idx) names, list(round(p, 4) order by round(p, 4) desc, idx) conf from k where kind is not null group by 1, 2)"""


def _tags(spark, d):
    vocab = spark.range(64).selectExpr("cast(id as int) idx", "concat('tag_', id) name", "case when id % 16 = 9 then 9 when id % 8 = 4 then 4 when id % 7 = 3 then 3 when id % 11 = 5 then 5 when id % 13 = 1 then 8 else 0 end category")
    return M.select_tags(_vectors(spark, d).select("id", F.transform("e", lambda x: x + F.lit(0.3)).alias("probs")), vocab, 0.35, 0.5)


@query(f"with {_PICK} select v.id, coalesce(g.names, []) general, coalesce(c.names, []) character, coalesce(r.names, []) rating, coalesce(g.conf, []) general_conf from v left join l g on g.id = v.id and g.kind = 'general' left join l c on c.id = v.id and c.kind = 'character' left join l r on r.id = v.id and r.kind = 'rating'")
def m3_select_tags(spark, d):
    names = [F.transform(k, lambda t: t["name"]).alias(k) for k in ("general", "character", "rating")]
    return _tags(spark, d).select("id", *names, F.transform("general", lambda t: t["confidence"]).alias("general_conf"))


@query(f"with {_PICK} select v.id, replace(array_to_string(list_concat(coalesce(c.names, []), coalesce(g.names, []), coalesce(r.names[1:1], [])), ', '), '_', ' ') tags from v left join l g on g.id = v.id and g.kind = 'general' left join l c on c.id = v.id and c.kind = 'character' left join l r on r.id = v.id and r.kind = 'rating'")
def m4_tag_string(spark, d):
    return _tags(spark, d).select("id", M.tag_string(True).alias("tags"))


_NAMES = "[" + ", ".join(f"'{x}'" for x in _LABELS) + "]"
_SCORES = f"""{_V}, s as (select id, label, {_NAMES} labels, list_transform(e[1:8], lambda x: abs(x)) probs, list_transform(e[9:12], lambda x: abs(x)) classes from v),
 t as (select *, list_position(probs, list_max(probs)) top_at, list_transform([1,2,3,4,5,6,7], lambda i: probs[i]) k from s),
 a as (select *, labels[top_at] aesthetic_label, round(list_dot_product(k, [10.0, 8.6, 7.4, 6.1, 4.6, 2.4, 0.0]::double[]) / list_sum(k), 3) score from t)"""
_GATE = f"""{_SCORES}, c as (select *, ['art', 'photo', 'text', 'map'][list_position(classes, list_max(classes))] raw_class_label, list_max(classes) top, greatest(classes[1], classes[4]) ok_conf, case when classes[1] >= classes[4] then 'art' else 'map' end ok_label from a),
 g as (select *, raw_class_label in ('art', 'map') and top >= 0.1 direct, case when raw_class_label in ('art', 'map') and top >= 0.1 then '' when top - ok_conf <= 0.08::double and ok_conf >= 0.1 then 'margin'
 when ok_conf >= 0.1 and aesthetic_label not in ('low', 'worst') and score >= 4.3 then 'aesthetic' else '' end fallback from c), p as (select *, direct or fallback != '' passed from g),
 o as (select id, id pos, raw_class_label, round(top, 6) raw_class_confidence, case when fallback != '' then ok_label else raw_class_label end class_label, round(case when fallback != '' then ok_conf else top end, 6) class_confidence, passed, fallback,
 case when passed then aesthetic_label else '' end aesthetic_label, case when passed then score end score, case when id % 29 = 0 then null else id % 13 != 0 end ok from p), z as (select *, coalesce(score < 5, false) low from o)"""


def _scored(spark, d):
    probs = lambda a, n: F.transform(F.slice("e", a, n), lambda x: F.abs(x))
    labels = lambda names: F.array(*[F.lit(x) for x in names])
    s = _vectors(spark, d).select("id", probs(1, 8).alias("ap"), labels(_LABELS).alias("al"), probs(9, 4).alias("probs"), labels(("art", "photo", "text", "map")).alias("labels"))
    return s.withColumns({"aesthetic_label": M.top_label(F.col("al"), F.col("ap"))["label"], "score": M.aesthetic_score(F.col("al"), F.col("ap"))})


def _gated(spark, d):
    g = M.class_gate(_scored(spark, d), ["art", "map"], 0.1, 0.08)
    ok = F.when(F.col("id") % 29 == 0, F.lit(None)).otherwise(F.col("id") % 13 != 0)
    return M.score_gate(g.withColumns({"ok": ok, "pos": F.col("id"), "error": F.when(F.col("id") % 2 == 0, "bad image")}), 5, True)


@query(f"with {_SCORES} select id, aesthetic_label label, list_max(probs) confidence from a")
def m5_top_label(spark, d):
    return _scored(spark, d).select("id", F.col("aesthetic_label").alias("label"), M.top_label(F.col("al"), F.col("ap"))["confidence"].alias("confidence"))


@query(f"with {_SCORES} select id, score from a")
def m6_aesthetic_score(spark, d):
    return _scored(spark, d).select("id", "score")


@query(f"with {_GATE} select id, raw_class_label, raw_class_confidence, class_label, class_confidence, passed, fallback from z")
def m7_class_gate(spark, d):
    return _gated(spark, d).select("id", "raw_class_label", "raw_class_confidence", "class_label", "class_confidence", "passed", "fallback")


@query(f"with {_GATE} select id, score, low from z")
def m8_score_gate(spark, d):
    return _gated(spark, d).select("id", "score", "low")


@query(f"with {_GATE} select count(*) filter (ok) total, count(*) filter (ok and score is not null) scored, count(*) filter (ok and not passed) rejected, count(*) filter (ok and low) low, avg(score) filter (ok) mean_score from z")
def m9_score_summary(spark, d):
    return M.score_summary(_gated(spark, d))


@query(f"with {_GATE} select id, row_number() over (order by case when ok is null then 4 when not ok then 3 when not passed then 1 when low then 0 else 2 end, coalesce(score, 99), pos) - 1 place from z")
def m10_review_order(spark, d):
    return M.ranked(_gated(spark, d)).select("id", "place")


@query(f"with {_GATE} select id from z where ok and score is not null and score >= 5 and passed")
def m11_keep_passed(spark, d):
    return M.keep_passed(_gated(spark, d), 5).select("id")


@query(f"with {_GATE} select id from z where not coalesce(ok and score is not null and score >= 5 and passed, false)")
def m11_low_files(spark, d):
    return M.low_files(_gated(spark, d), 5).select("id")


@query(f"""with {_GATE} select id, case when ok then concat_ws(', ', concat('score:', coalesce(cast(round(score::decimal(10,3), 2)::decimal(10,2) as varchar), '-')), concat('quality:', coalesce(nullif(aesthetic_label, ''), '-')), concat('class:', class_label), concat('class_conf:', cast(floor(class_confidence * 100 + 0.5::double) as bigint), '%'),
 case when not passed then 'class_passed:no' end, case when low then 'low_score:yes' end, case when fallback != '' then concat('fallback:', fallback) end, case when raw_class_label != class_label then concat('raw_class:', raw_class_label) end) else concat('error: ', case when id % 2 = 0 then 'bad image' else 'failed' end) end text from z""")
def m12_format_score_text(spark, d):
    return _gated(spark, d).select("id", M.format_score_text().alias("text"))
