"""The opN_ queries over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, language_model, mixing, neighbours, pieces, prefix_trie, quality_classifier, quality_rules, simhash, substrings, token_files, toxicity, vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).drop("source")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def digests(rows: DataFrame) -> DataFrame:
    """op3's columns from encode_pieces(); ends_sha256 is of the decimal places in the text's UTF-8 where each piece
    ends, which is where the next begins."""
    joined = lambda c: F.sha2(F.array_join(F.col(c).cast("array<string>"), " "), 256)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), joined("ids").alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), joined("ends").alias("ends_sha256"))


def op1_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.vector_groups(_table(spark, sf_dir, "embeddings"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(pieces.encode_pieces(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model")))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_files.token_files(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return rows.select("doc_id", "start", F.expr("cast(length(ids) div 4 as long)").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op11_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_nodes(_table(spark, sf_dir, "conversations"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op11_nearest_vectors, op12_prefix_trie, op13_source_divergence, op1_vector_dedup, op2_simhash, op3_sentencepiece, op4_substring_dedup, op6_quality_classifier, op7_lm_score, op8_token_files, op5_mix_sources, op9_quality_rules, op10_toxicity)}
_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x != '')"


def _broken_rules() -> str:
    """The threshold table of op9 as one SQL condition."""
    parts = []
    for _, top, bottom, low, high in quality_rules.RULES:
        ratio = f"(case when {bottom} > 0 then {top} / {bottom}::double else 0 end)"
        parts += [f"{ratio} < {low}::double"] * (low is not None) + [f"{ratio} > {high}::double"] * (high is not None)
    return " or ".join(parts)


#: Queries without SQL here are tested against brute force in tests/llm.
ORACLE: dict[str, str] = {
    "op1_vector_dedup": """with recursive v as (select vec_id, label, list_transform(embedding, lambda x: x::double) e from embeddings),
 u as (select vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) u from v where list_dot_product(e, e) > 0),
 l as (select a.vec_id a, b.vec_id b from u a join u b on a.label = b.label and a.vec_id != b.vec_id and list_dot_product(a.u, b.u) >= 0.93),
 r as (select vec_id id, vec_id reach from v union select r.id, l.b from r join l on l.a = r.reach),
 c as (select id, min(reach) component_id from r group by id), n as (select a, count(*) n from l group by a)
 select v.vec_id, coalesce(n.n, 0)::bigint n_links, c.component_id, v.vec_id = c.component_id kept from v join c on c.id = v.vec_id left join n on n.a = v.vec_id""",
    "op4_substring_dedup": f"""with d as (select doc_id, {_WORDS} w from documents), win as (select doc_id, p, array_to_string(w[p:p + 49], ' ') s from (select doc_id, w, unnest(range(1, len(w) - 48)) p from d)),
 low as (select s, min(doc_id) low from win group by s), gone as (select distinct doc_id, unnest(range(p, p + 50)) i from (select win.doc_id, win.p from win join low using (s) where low.low < win.doc_id)),
 each as (select doc_id, unnest(w) word, generate_subscripts(w, 1) i from d), kept as (select e.doc_id, string_agg(word, ' ' order by e.i) t, count(*) n from each e anti join gone g on g.doc_id = e.doc_id and g.i = e.i group by e.doc_id)
 select d.doc_id, len(w)::bigint n_words, (len(w) - coalesce(n, 0))::bigint n_removed, sha256(coalesce(t, '')) kept_sha256 from d left join kept k on k.doc_id = d.doc_id""",
    "op9_quality_rules": rf"""with d as (select doc_id, coalesce(text, '') t, {_WORDS} w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) lines from documents),
 win as (select doc_id, p, array_to_string(w[p:p + 7], ' ') s from (select doc_id, w, unnest(range(1, len(w) - 6)) p from d)), twice as (select doc_id, s from win group by 1, 2 having count(*) > 1),
 rep as (select doc_id, count(distinct i) n from (select win.doc_id, unnest(range(p, p + 8)) i from win join twice using (doc_id, s)) group by 1),
 m as (select d.doc_id, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint n_symbols, (len(lines) - len(list_distinct(lines)))::bigint n_dup_lines, coalesce(rep.n, 0)::bigint n_repeat_words, len(lines)::bigint n_lines,
  len(list_filter(w, lambda x: lower(x) in ({", ".join(f"'{x}'" for x in dict.fromkeys(quality_rules.STOP_WORDS))})))::bigint n_stop_words, len(list_filter(w, lambda x: length(x) > 1 and x = upper(x) and x != lower(x)))::bigint n_shouted from d left join rep on rep.doc_id = d.doc_id),
 b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed from m) select *, not base_failed and not ({_broken_rules()}) kept from b""",
    "op12_prefix_trie": """with t as (select conv_id c, coalesce(role, '') r, coalesce(text, '') x, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) i from conversations where conv_id is not null),
 own as (select c, list({r: r, x: x} order by i) w from t group by c),
 h as (select c, w, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(c::varchar) + 1), lambda k: ascii(substr(c::varchar, k, 1))::bigint)), lambda a, b: list_reduce(list_prepend(xor(a, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) % 6 h from own),
 full_ as (select h.c, list_concat(coalesce(b.w, [])[1:h.h], h.w[h.h + 1:]) w from h left join own b on b.c = h.c - h.c % 100),
 cut as (select c, w, unnest(range(0, len(w) + 1)) d from full_), n as (select w[1:d] k, d, min(c) conv_id, count(*) n, coalesce(length(w[1:d][d].x), 0) size, coalesce(string_agg(c::varchar, ',' order by c) filter (len(w) = d), '') ends from cut group by w[1:d], d),
 kid as (select k[1:d - 1] k, count(*) n from n where d > 0 group by 1), leaf as (select n.k, n.d from n left join kid on kid.k = n.k where kid.n is null),
 under as (select k[1:a] k, sum(leaf) leaves, sum(saved) saved from (select n.k, unnest(range(0, n.d + 1)) a, (leaf.k is not null)::bigint leaf, (n.n - 1) * n.size saved from n left join leaf on leaf.k = n.k) group by 1)
 select n.conv_id, n.d depth, up.conv_id parent_conv_id, n.n n_convs, coalesce(kid.n, 0) n_children, under.leaves::bigint n_leaves, under.saved::bigint saved_tokens, sha256(n.ends) ends_sha256
 from n join under on under.k = n.k left join kid on kid.k = n.k left join n up on n.d > 0 and up.k = n.k[1:n.d - 1]""",
    "op13_source_divergence": r"""with d as (select coalesce(lang, '') lang, coalesce(source, '') source, row_number() over () id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) t from documents),
 e as (select lang, source, id, unnest(t) term from d), k as (select lang, term, count(*) n from e group by 1, 2 having count(distinct id) >= 3), v as (select lang, count(*) v, sum(n) n from k group by 1),
 c as (select e.lang, e.source, e.term, count(*) n from e join k on k.lang = e.lang and k.term = e.term group by all), tot as (select lang, source, sum(n) n from c group by 1, 2),
 g as (select a.lang, a.source, coalesce(tot.n, 0)::hugeint n, coalesce(v.v, 0) v from (select distinct lang, source from d) a left join tot on tot.lang = a.lang and tot.source = a.source left join v on v.lang = a.lang),
 p as (select g.lang, g.source, k.term, coalesce(c.n, 0) n, 1 + 1000000000::hugeint * (coalesce(c.n, 0) + 1) // (g.n + g.v) p from g join k on k.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
 l as (select k.lang, term, 1 + 1000000000::hugeint * (k.n + 1) // (v.n::hugeint + v.v) q from k join v on v.lang = k.lang),
 two as (select a.lang, a.source, b.source item, sum((a.p - b.p) * (a.p - b.p) // b.p) value from p a join p b on a.lang = b.lang and a.term = b.term and a.source != b.source group by all),
 u as (select a.lang, a.source, 'pair' part, b.source item, coalesce(two.value, 0)::bigint value from g a join g b on a.lang = b.lang and a.source != b.source left join two on two.lang = a.lang and two.source = a.source and two.item = b.source
  union all select p.lang, p.source, 'term', p.term, ((p - q) * (p - q) // q)::bigint from p join l on l.lang = p.lang and l.term = p.term where p.n > 0 and p.p > l.q),
 r as (select *, (row_number() over (partition by lang, source, part order by value desc, item))::int rank from u) select * from r where part = 'pair' or rank <= 200""",
}
