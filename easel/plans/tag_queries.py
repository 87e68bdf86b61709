"""Queries for tags, captions, composition and incremental runs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from easel.functions import tags as T
from easel.operators import tags as O
from easel.streaming import ledger as L

from . import compose as X
from .staging import shared_dir
from .tables import images, table, with_images

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None, over_images: bool = True):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = with_images(sql) if over_images else sql
        return f

    return keep


_T = "list_filter(list_transform(string_split(text, ','), lambda t: trim(t)), lambda t: t != '')"


@query(f"select file, {_T} tags, array_to_string({_T}, ', ') joined from images")
def t1_split_join(spark, d):
    return images(spark, d).select("file", T.split_tags(F.col("text")).alias("tags"), T.join_tags(T.split_tags(F.col("text"))).alias("joined"))


@query(f"select tag, count(*) n from (select unnest({_T}) tag from images) group by tag")
def t2_tag_stats(spark, d):
    return O.tag_stats(images(spark, d))


@query(f"select tag, n, row_number() over (order by n desc, tag) place from (select tag, count(*) n from (select unnest({_T}) tag from images) group by tag) where contains(lower(tag), 'r')")
def t3_search_sort_tags(spark, d):
    from pyspark.sql import Window

    return O.search_sort_tags(O.tag_stats(images(spark, d)), "R").withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "tag")))


@query(f"""select file, 'and' as mode from images where list_has_all({_T}, ['red', 'economy']) union all select file, 'or' from images where list_has_any({_T}, ['red', 'brand#1']) union all select file, 'none' from images where not list_has_any({_T}, ['red', 'brand#1'])""")
def t4_filter_by_tags(spark, d):
    i = images(spark, d)
    pick = lambda tags, mode: O.filter_by_tags(i, tags, mode).select("file", F.lit(mode).alias("mode"))
    return pick(["red", "economy"], "and").unionByName(pick(["red", "brand#1"], "or")).unionByName(pick(["red", "brand#1"], "none"))


def _insert(front: bool) -> str:
    new = f"list_filter(['red', 'best', 'best'], lambda x: not list_contains({_T}, x))"
    both = f"list_concat({new}, {_T})" if front else f"list_concat({_T}, {new})"
    return f"select file, case when len({new}) > 0 then array_to_string({both}, ', ') else text end text, len({new}) > 0 changed from images"


@query(_insert(True))
def t5_prepend_tags(spark, d):
    return O.edit(images(spark, d), lambda c: T.prepend_tags(c, ["red", "best", "best"])).select("file", "text", "changed")


@query(_insert(False))
def t5_append_tags(spark, d):
    return O.edit(images(spark, d), lambda c: T.append_tags(c, ["red", "best", "best"])).select("file", "text", "changed")


@query(f"select file, case when list_contains({_T}, 'red') then array_to_string(list_transform({_T}, lambda t: case when t = 'red' then 'crimson' else t end), ', ') else text end text from images")
def t6_replace_tag(spark, d):
    return O.edit(images(spark, d), lambda c: T.replace_tag(c, "red", "crimson")).select("file", "text")


@query(f"select file, case when list_contains({_T}, 'red') then array_to_string(list_filter({_T}, lambda t: t != 'red'), ', ') else text end text, list_contains({_T}, 'red') changed from images")
def t7_remove_tag(spark, d):
    return O.edit(images(spark, d), lambda c: T.remove_tag(c, "red")).select("file", "text", "changed")


@query(f"select file from images where list_contains({_T}, 'red')")
def t8_changed_rows(spark, d):
    return O.changed_rows(O.edit(images(spark, d), lambda c: T.remove_tag(c, "red"))).select("file")


@query("select file from images where file % 3 = 0")
def t9_target_rows(spark, d):
    return O.target_rows(images(spark, d), images(spark, d).where("file % 3 = 0")).select("file")


@query("select d.doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id and l.quality = 1)", False)
def t10_skip_existing(spark, d):
    captions = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise(" ").alias("caption"))
    return O.skip_existing(table(spark, d, "documents"), captions, "doc_id", "caption").select("doc_id")


@query("select doc_id, case (row_number() over (order by doc_id) - 1) % 3 when 0 then 'a' when 1 then 'c' else 'd' end config from documents", False)
def t11_round_robin(spark, d):
    configs = [{"name": "a", "model": "x"}, {"name": "b"}, {"name": "c", "model": "y"}, {"name": "d", "model": "z"}]
    return O.assign_round_robin(table(spark, d, "documents").select("doc_id"), configs, "doc_id").select("doc_id", "config")


@query(r"select conv_id, turn, trim(regexp_replace(concat('<think>', role, chr(10), 'x</think> ', text), '(?s)<think>.*?</think>\s*', '', 'g'), concat(' ', chr(9), chr(10), chr(13))) text from conversations", False)
def t12_strip_think(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", T.strip_think(F.concat(F.lit("<think>"), "role", F.lit("\nx</think> "), "text")).alias("text"))


_MODEL = "concat(case conv_id % 4 when 0 then 'Gemini-' when 1 then 'my-CLAUDE-' when 2 then 'gpt-' else '' end, role)"


@query(f"select conv_id, turn, case when contains(lower({_MODEL}), 'gemini') then 'gemini' when contains(lower({_MODEL}), 'claude') then 'claude' else 'openai' end provider from conversations", False)
def t13_detect_provider(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.detect_provider(F.expr(_MODEL)).alias("provider"))


@query("""select conv_id, turn, concat('{"messages":[', case when turn % 2 = 0 then '{"role":"system","content":"be brief"},' else '' end, '{"role":"user","content":"', role, ' <image:', conv_id, '>"}],"max_tokens":300}') prompt from conversations""", False)
def t14_build_prompts(spark, d):
    system = F.when(F.col("turn") % 2 == 0, "be brief").otherwise(" ")
    return table(spark, d, "conversations").select("conv_id", "turn", T.build_prompts(system, F.col("role"), F.col("conv_id").cast("string"), 300).alias("prompt"))


@query("select d.doc_id, coalesce(l.quality = 1, false) ok, case when l.doc_id is null then 'cancelled' when l.quality = 0 then 'poor' end error, case when l.quality = 1 then 'fine' end text from documents d left join labels l on l.doc_id = d.doc_id", False)
def t15_fill_cancelled(spark, d):
    good = F.col("quality") == 1
    r = table(spark, d, "labels").select("doc_id", good.alias("ok"), F.when(~good, "poor").alias("error"), F.when(good, "fine").alias("text"))
    return O.fill_cancelled(table(spark, d, "documents"), r, "doc_id")


@query("select doc_id, case when length(text) > 60 then concat(left(text, 60), '...') else text end preview from documents", False)
def t16_preview(spark, d):
    return table(spark, d, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


@query("select file, min(source) source, arg_min(pos, source) pos from (select file, 0 source, pos from images where file % 2 = 0 union all select file, 1, pos + 5 from images where file % 3 = 0) group by file")
def x1_union_inputs(spark, d):
    i = images(spark, d)
    return X.union_inputs([i.where("file % 2 = 0"), i.where("file % 3 = 0").withColumn("pos", F.col("pos") + 5)])


@query("select file, arg_max(text, e) text from (select file, text, 0 e from images union all select file, 'new', 1 from images where file % 4 = 0) group by file")
def x2_merge_metadata(spark, d):
    i = images(spark, d)
    return X.merge_metadata([i, i.where("file % 4 = 0").withColumn("text", F.lit("new"))])


@query("select file, unnest(case when file % 4 = 0 then [concat('a', file), concat('b', file)] when file % 4 = 1 then [concat('o', file)] when file % 4 = 2 then [cast(file as varchar)] else [] end) output from images")
def x3_collect_outputs(spark, d):
    f, m = F.col("file").cast("string"), F.col("file") % 4
    return X.collect_outputs(images(spark, d).select("file", F.when(m == 0, F.array(F.concat(F.lit("a"), f), F.concat(F.lit("b"), f))).alias("outputs"), F.when(m == 1, F.concat(F.lit("o"), f)).alias("output"), (m == 2).alias("skipped")))


@query("select count(*) filter (s and not k) processed, count(*) filter (not s) failed, count(*) filter (s and k) skipped, count(*) total from (select o_orderstatus != 'F' s, o_orderkey % 5 = 0 k from orders)", False)
def x4_batch_summary(spark, d):
    return X.batch_summary(table(spark, d, "orders").select((F.col("o_orderstatus") != "F").alias("ok"), (F.col("o_orderkey") % 5 == 0).alias("skipped")))


@query("select file, text from images where width >= 512 and height >= 512 and file % 7 != 0")
def x5_pipeline(spark, d):
    from easel.functions.geometry import resolution_filter

    given = "file long, width int, height int, grp long, text string"
    steps = [
        X.Step("sized", lambda i: resolution_filter(i, 512, 0, 512).where("not filtered").drop("filtered"), ["images"], [given], given),
        X.Step("grouped", lambda s: s.where("grp is not null"), ["sized"], ["grp long"], "file long, text string"),
        X.Step("unused", lambda s: 1 / 0, ["sized"]),
        X.Step("saved", lambda g, s: g.select("file", "text").join(s.select("file"), "file", "left_semi"), ["grouped", "sized"], ["file long, text string", "file long"]),
    ]
    return X.Pipeline(steps, ["saved"], {"images": given}).run({"images": images(spark, d)})["saved"]


@query("select cast(event_id as varchar) id from events where event_type != 'error'", False)
def x6_ledger_stream(spark, d):
    """Runs the stream twice, the second time from a new checkpoint, and returns the ledger."""
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = table(spark, d, "events")
    for n in (1, 2):
        L.ledger_stream(spark, f"{d}/events.parquet", events.schema, f"{at}/ledger", f"{at}/checkpoint-{n}", lambda df: df.select("event_id", (F.col("event_type") != "error").alias("ok")), f"{at}/out", "event_id")
    return L.read_ledger(spark, f"{at}/ledger")
