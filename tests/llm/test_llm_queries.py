"""Registered queries at the smallest scale: SQL where there is some, and the pipeline's stages."""

import collections
import hashlib
import random

import duckdb
import pytest
import sentencepiece
import test_llm_small as small

import __spark_entry__ as entry
import corpus_pipeline
from easel.llm import mixing, toxicity
from easel.llm import queries as Q
from easel.llm.shared import stage

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = Q.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(Q.ORACLE[name])
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    assert sorted(str([r[c] for c in cols]) for r in df.collect()) == sorted(str([r[i] for i in at]) for r in rel.fetchall())


def test_registered():
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in Q.QUERIES}
    assert entry.queries()["pipeline"] is corpus_pipeline.run


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given = docs
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        out = stage(f(spark, docs, SF), name)
        assert out.count() > 0
        if k < 4:
            assert out.columns == given.columns
        if k < 3:
            assert out.count() <= docs.count()
        docs = out
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ends_sha256"]
    assert sorted(map(str, docs.collect())) == sorted(map(str, corpus_pipeline.run(spark, SF).collect()))


def test_pipeline_stages_by_brute_force(spark, tmp_path):
    """Each stage on a small table with null and repeated ids and columns of all sorts of names, against plain Python."""
    rng = random.Random(3)
    rows = []
    for i in range(260):
        t = small.prose(rng, rng.randint(3, 90)) + (" grolf" + rng.choice(["an", "in"]) if i % 4 == 1 else "")
        rows.append((i, t, "abc"[i % 3]))
    rows += [(300 + k, rows[k][1], "b") for k in range(0, 40, 2)] + [(7, rows[8][1], "c"), (None, rows[3][1], "a"), (None, None, None), (400, "", None), (5, rows[5][1], "a")]
    long = small.prose(rng, 70)
    rows += [(500 + k, small.prose(rng, 20 + 7 * k) + " " + long, "a") for k in range(4)]
    docs = small.clashing(small.table(spark, rows))
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 1)) for i in range(260)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    key = lambda r: (1 << 60 if r[0] is None else r[0], r[1] or "", str(r[2]))
    of = lambda df: sorted(((r["doc_id"], r["text"], r["source"]) for r in df.collect()), key=key)
    f = dict(corpus_pipeline.STAGES)

    scorer = toxicity.train_toxicity(docs, labels)
    clean = f["toxicity"](spark, docs, str(tmp_path))
    left = sorted((r for r in rows if scorer.scores([(r[1] or "").encode()])[0] < 0.5), key=key)
    assert of(clean) == left and 0 < len(left) < len(rows) and not any(" grolf" in (r[1] or "") for r in left)

    first = f["simhash"](spark, stage(clean, "clean"), str(tmp_path))
    fps = sorted({small._fingerprint(r[1]) for r in left})
    root = small._brute_components(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    groups = {}
    for r in left:
        groups.setdefault(root[fps.index(small._fingerprint(r[1]))], []).append(r)
    want = sorted((min(g, key=lambda r: (r[0] is None, r[0] or 0, small._signed(small._fingerprint(r[1])))) for g in groups.values()), key=key)
    assert of(first) == want

    cut = f["substrings"](spark, stage(first, "first"), str(tmp_path))
    seen, kept = {}, []
    for i, t, _ in sorted((r for r in want if r[0] is not None), key=key):
        w = small.words(t)
        for p in range(len(w) - 49):
            seen.setdefault(tuple(w[p : p + 50]), i)
    for i, t, s in want:
        w = small.words(t)
        gone = [False] * len(w)
        for p in range(len(w) - 49 if i is not None else 0):
            if seen[tuple(w[p : p + 50])] < i:
                gone[p : p + 50] = [True] * 50
        if not (w and all(gone)):
            kept.append((i, b" ".join(x for x, g in zip(w, gone) if not g).decode() if any(gone) else t, s))
    assert of(cut) == sorted(kept, key=key) and kept != want

    cut = stage(cut, "cut")
    mixed = stage(f["mixing"](spark, cut, str(tmp_path)), "mixed")
    plan, n = collections.Counter(), collections.Counter()
    for r in mixing.mix_sources(cut).collect():  # itself tested by brute force
        plan[r["doc_id"], r["source"]] += r["taken"]
    texts = {}
    for i, t, src in kept:
        texts.setdefault((i, src), []).append(t)
    for i, t, src in of(mixed):
        n[i, src] += len(small.words(t))
        assert t in texts[i, src] or any(_part_of(small.words(t), small.words(x)) for x in texts[i, src])
    assert n == collections.Counter({k: v for k, v in plan.items() if v})

    model = sentencepiece.SentencePieceProcessor(model_file=small.PIECES)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["ids_sha256"]) for r in f["sentencepiece"](spark, mixed, str(tmp_path)).collect())
    assert got == sorted((-1 if i is None else i, hashlib.sha256(" ".join(map(str, model.encode(t) + [2])).encode()).hexdigest()) for i, t, _ in of(mixed))


def _part_of(some, whole):
    """Whether the words of some stand in whole in this order."""
    rest = iter(whole)
    return all(w in rest for w in some)
