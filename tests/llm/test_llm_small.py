"""The operators on small tables: nulls, empties, repeats, clashing columns, and brute force."""

import collections
import hashlib
import itertools
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from easel.llm import labelled, language_model, mixing, pieces, quality_classifier, quality_rules, simhash, substrings, token_files, toxicity, vectors
from easel.llm import queries as Q
from easel.llm.shared import components

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, score string, `key` string, a int, b int, word string, fp string, row string, label string, shard string"


def words(t):
    return WORD.findall((t or "").encode())


def table(spark, rows):
    """(doc_id, text, source) rows with further columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, "x", "k", 1, 2, "w", "f", "r", "l", "s") for i, t, s in rows], SCHEMA)


def prose(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "an", "in", "ou", "é"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    base, shared = prose(rng, 120), prose(rng, 70)
    out = [(0, base, "b"), (1, base, "b"), (2, base + " x", "a"), (3, None, None), (4, "", "c"), (5, " \n\t", "c"), (6, "One", "a"), (7, "one TWO three", "a"), (8, "one two three", None)]
    out += [(9, shared + " " + prose(rng, 30), "b"), (10, prose(rng, 13) + "\n" + shared, "b"), (11, prose(rng, 9) + " " + shared + " " + base, "a"), (12, "w " * 400, "b"), (13, "w " * 500, "b")]
    out += [(14, prose(rng, 3000), "b"), (14, base, "b"), (15, "漢字 ▁ \x00 é\r\n  two  spaces", "b"), (None, base, "b"), (16, "it's <|endoftext|> x's,\n\nend.\n", "c")]
    return out + [(i, prose(rng, rng.randint(5, 80)), "ab"[i % 2]) for i in range(17, 40)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return table(spark, corpus)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def collected(df, key="doc_id"):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: str(sorted(map(str, r.items()))))


def test_components_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 101), (101, 100), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def _brute_components(n, linked):
    low = list(range(n))

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for i, j in linked:
        a, b = root(i), root(j)
        low[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_vectors(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(120, 8))
    v[40:80] = v[0] + rng.normal(size=(40, 8)) * 0.25
    v[80:84] = v[5]
    v[84] = 3 * v[5]
    rows = [(i, [float(np.float32(c)) for c in x], i % 2 if i < 40 else 0) for i, x in enumerate(v)]
    odd = [(200, None, 0), (201, [], 0), (202, [0.0] * 8, 0), (203, [math.nan] * 8, 0), (204, [math.inf] + [1.0] * 7, 0), (205, [None] + [1.0] * 7, 0), (206, rows[5][1], None)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    x = np.array([r[1] for r in rows])
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    lab = np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.93) & (lab[:, None] == lab[None, :]) & ~np.eye(len(x), dtype=bool)
    root = _brute_components(len(x), zip(*np.nonzero(near)))
    for block, per_label in ((2048, 8), (16, 4), (7, 1)):
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.vector_groups(df, block=block, per_label=per_label).collect()}
        assert got == {i: (int(near[i].sum()), root[i], root[i] == i) for i in range(len(x))} | {i: (0, i, True) for i, _, _ in odd}
    assert vectors.vector_groups(df.limit(0)).collect() == []
    # repeated and null ids, and columns with other operators' names
    ids = [None if i % 11 == 3 else i % 50 for i in range(len(rows))]
    twice = spark.createDataFrame([(k, r[1], r[2], "x", 1, 2) for k, r in zip(ids, rows)], "vec_id long, embedding array<float>, label int, class_id string, low int, cell int")
    low = {c: min((k for k, r in zip(ids, root) if r == c and k is not None), default=None) for c in set(root)}
    want = sorted(str((k, int(near[i].sum()), low[root[i]], k == low[root[i]])) for i, k in enumerate(ids))
    assert sorted(str(tuple(r)) for r in vectors.vector_groups(twice, block=16).collect()) == want


def test_vectors_of_doubles_and_wide_labels(spark):
    rows = [(1, [1e-200, 2e-200], 3_000_000_000), (2, [1.0, 2.0], 3_000_000_000), (3, [1.0, 2.0], 4_000_000_000), (4, [1e200, 2.1e200], 3_000_000_000), (5, [1.0, 2.0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")
    want = {1: (2, 1), 2: (2, 1), 3: (0, 3), 4: (2, 1), 5: (0, 5)}
    named = df.withColumn("label", F.concat(F.lit("l"), F.col("label").cast("string")))
    for given in (df, named, df.withColumn("label", F.col("label").cast("double"))):
        assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.vector_groups(given).collect()} == want


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def clashing(docs):
    """docs with columns whose names operators might use for themselves."""
    return docs.withColumns({f"_{c}": F.lit(str(i)) for i, c in enumerate("sum whole all copy kept removed row passes key id spans tie fp text bad gone".split())})


def _fingerprint(t):
    w = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, corpus, empty):
    got = collected(simhash.simhash_groups(docs))
    fps = sorted({_fingerprint(t) for _, t, _ in corpus})
    root = _brute_components(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    low = {}
    for i, t, _ in corpus:
        k = root[fps.index(_fingerprint(t))]
        low[k] = min(low.get(k, 1 << 60), 1 << 60 if i is None else i)
    want = [{"doc_id": i, "fingerprint": f"{_fingerprint(t):016x}", "component_id": low[root[fps.index(_fingerprint(t))]]} for i, t, _ in corpus]
    assert got == sorted(want, key=lambda r: str(sorted(map(str, r.items()))))
    assert simhash.simhash_groups(empty).collect() == []
    for given, rows in ((docs, corpus), (clashing(docs.unionByName(docs)), corpus + corpus)):
        groups = {}
        for i, t, _ in rows:
            groups.setdefault(root[fps.index(_fingerprint(t))], []).append((1 << 60 if i is None else i, _signed(_fingerprint(t)), t))
        kept = simhash.keep_first(given)
        got = [(1 << 60 if r["doc_id"] is None else r["doc_id"], _signed(_fingerprint(r["text"])), r["text"]) for r in kept.collect()]
        assert kept.columns == given.columns and sorted(g[:2] for g in got) == sorted(min(x[:2] for x in g) for g in groups.values())
        assert all(g in groups[root[fps.index(_fingerprint(g[2]))]] for g in got)
        assert kept.limit(0).collect() == simhash.keep_first(given.limit(0)).collect() == []


def test_golay_keys_meet_within_four_bits():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for errors in range(5):
        y = x.copy()
        for i in range(len(y)):
            for b in rng.choice(64, errors, replace=False):
                y[i] ^= np.uint64(1) << np.uint64(b)
        (rx, kx), (ry, ky) = simhash.golay_keys(x), simhash.golay_keys(y)
        a, b = set(zip(rx.tolist(), kx.tolist())), set(zip(ry.tolist(), ky.tolist()))
        assert {r for r, _ in a & b} == set(range(len(x)))
    table, n = simhash.golay_errors()
    assert sorted(collections.Counter(n.tolist()).items()) == [(1, 277), (6, 1771)]


def test_forest_of_dense_and_sparse_runs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    f = np.unique(np.concatenate([base[:1] ^ (np.uint64(1) << rng.integers(0, 60, 40).astype(np.uint64)), base, rng.integers(0, 1 << 63, 30, dtype=np.uint64)]))
    links = [(i, j) for i in range(len(f)) for j in range(i) if int(f[i] ^ f[j]).bit_count() <= 4]
    at = {int(x): i for i, x in enumerate(f)}
    got = [(at[int(a)], at[int(b)]) for a, b in simhash.forest(f.copy())]
    assert _brute_components(len(f), links) == _brute_components(len(f), got) and len(got) < len(f)


def _ends(m, t, ids):
    """Where each piece ends in the text's bytes: marks are put in front and for spaces, and pieces spell what comes out."""
    step = [0, 0, 0]
    for c in t:
        step += [0, 0, 1] if c == " " else [1] * len(c.encode())
    at, ends = 0, []
    for i in ids:
        at += 0 if m.is_control(i) else 1 if m.is_byte(i) else len(m.id_to_piece(i).encode())
        ends.append(sum(step[:at]))
    return ends


def test_pieces(docs, corpus, empty):
    m = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = []
    for i, t, _ in corpus:
        ids = m.encode(t or "") + [2]
        want.append({"doc_id": i, "n_tokens": len(ids), "ids_sha256": hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), "decoded_sha256": hashlib.sha256(m.decode(ids).encode()).hexdigest(), "ends_sha256": hashlib.sha256(" ".join(map(str, _ends(m, t or "", ids))).encode()).hexdigest()})
    assert collected(Q.digests(pieces.encode_pieces(docs, PIECES))) == sorted(want, key=lambda r: str(sorted(map(str, r.items()))))
    assert pieces.encode_pieces(empty, PIECES).collect() == []


def test_piece_spans_tile_the_source():
    model = pieces.PieceModel(PIECES)
    rng = random.Random(3)
    for _ in range(400):
        t = "".join(rng.choice(" \n\tab▁ñ漢😀 the") for _ in range(rng.randint(0, 30))).encode()
        ids, ends = model.encode(t)
        begin = 0
        for i, e in zip(ids.tolist(), ends.tolist()):
            span = t[begin:e].replace("▁".encode(), b" ")
            assert i == model.end_id or model.surface[i] in (span, b" " + span)
            begin = e
        assert begin == len(t)


def _map_blob():
    import struct

    # a double array for the keys "a" -> 0 and "ab" -> 2, replacements "x" and "yz"
    units = [0] * 512
    units[0] = 1 << 10  # root: children at 1 ^ byte
    a = 1 ^ ord("a")
    units[a] = ord("a") | 1 << 8 | (200 ^ a) << 10
    units[200] = 0 | 1 << 31
    ab = 200 ^ ord("b")
    units[ab] = ord("b") | 1 << 8 | (300 ^ ab) << 10
    units[300] = 2 | 1 << 31
    return struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + b"x\0yz\0"


def test_character_map_takes_longest_prefix():
    text, source = pieces.CharacterMap(_map_blob()).normalise("éaabc".encode())
    assert text == "éxyzc".encode() and source.tolist() == [0, 1, 2, 3, 3, 5, 6]


def test_a_model_with_a_character_map(spark, tmp_path):
    """The same vocabulary with that map: ids and texts as the library's, ends by walking over normalised bytes."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto.FromString(open(PIECES, "rb").read())
    proto.normalizer_spec.precompiled_charsmap = _map_blob()
    path = str(tmp_path / "mapped.model")
    open(path, "wb").write(proto.SerializeToString())
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(6)
    texts = ["", "a", "ab", "banana cab aab", *("".join(rng.choice("aabcd é漢\n") for _ in range(rng.randint(1, 40))) for _ in range(120))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pieces.encode_pieces(df, path).collect():
        t = texts[r["doc_id"]]
        assert r["ids"] == m.encode(t) + [2] and r["decoded"] == m.decode(r["ids"])
        # each normalised byte's source: "ab" makes two bytes of one place, all else byte for byte
        source, i = [], 0
        while i < len(t.encode()):
            source += [i, i] if t.encode()[i : i + 2] == b"ab" else [i]
            i += 2 if t.encode()[i : i + 2] == b"ab" else 1
        source.append(len(t.encode()))
        at, want = -1 if t else 0, []
        for k in r["ids"]:
            at += 0 if m.is_control(k) else 1 if m.is_byte(k) else len(m.id_to_piece(k).replace("▁", " ").encode())
            want.append(source[at])
        assert r["ends"] == want


def test_substrings(docs, corpus, empty):
    first = {}
    for i, t, _ in sorted((c for c in corpus if c[0] is not None), key=lambda c: c[0]):
        w = words(t)
        for p in range(len(w) - 49):
            first.setdefault(tuple(w[p : p + 50]), i)
    want, kept_text = [], {}
    for i, t, _ in corpus:
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - 49 if i is not None else 0):
            if first[tuple(w[p : p + 50])] < i:
                gone[p : p + 50] = [True] * 50
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        want.append({"doc_id": i, "n_words": len(w), "n_removed": sum(gone), "kept_sha256": hashlib.sha256(kept).hexdigest()})
        if not (w and all(gone)):
            kept_text.setdefault(i, []).append(kept.decode() if any(gone) else t)
    got = substrings.substring_dedup(docs)
    assert collected(got.select("doc_id", "n_words", "n_removed", "kept_sha256")) == sorted(want, key=lambda r: str(sorted(map(str, r.items()))))
    assert substrings.substring_dedup(empty).collect() == []
    out = substrings.kept_documents(docs)
    texts = {}
    for r in out.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    assert out.columns == docs.columns and {k: sorted(map(str, v)) for k, v in texts.items()} == {k: sorted(map(str, v)) for k, v in kept_text.items()}
    other = clashing(docs)
    named = substrings.kept_documents(other)
    assert named.columns == other.columns and sorted(map(str, named.collect())) == sorted(map(str, clashing(out).collect()))
    assert substrings.kept_documents(other.limit(0)).collect() == []


def test_merged_by():
    rng = np.random.default_rng(0)
    d, a = rng.integers(0, 40, 2000), rng.integers(0, 300, 2000)
    b = a + rng.integers(1, 9, 2000)
    got = list(zip(*(x.tolist() for x in substrings.merged_by(d, a, b))))
    want = [(k, *r) for k in np.unique(d).tolist() for r in zip(*(x.tolist() for x in substrings.merged(a[d == k], b[d == k])))]
    assert got == want


def test_substrings_of_long_texts(spark):
    rng = random.Random(2)
    shared = prose(rng, 60)
    rows = [(1, shared), (2, prose(rng, 900_000) + " " + shared), (3, "x" * 2_000_000), (4, "x" * 2_000_000), (5, shared.replace(" ", "  "))]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substrings.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (60, 0), 2: (900_060, 60), 3: (1, 0), 4: (1, 0), 5: (60, 60)}


@pytest.fixture(scope="module")
def long_rows():
    """Texts above the size of a batch, and texts without any space."""
    rng = random.Random(8)
    return [(1, prose(rng, 900_000)), (2, "x" * 2_000_000), (3, "é漢" * 200_000), (4, None), (5, "a b\n" * 300_000), (6, "x" * 2_000_000)]


def test_long_texts_simhash_and_mixing(spark, long_rows):
    df = spark.createDataFrame([(*r, "s") for r in long_rows], "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_groups(df).collect()}
    fps = {i: _fingerprint(t) for i, t in long_rows}
    assert {i: f for i, (f, _) in got.items()} == {i: f"{f:016x}" for i, f in fps.items()} and got[6][1] == 2
    sizes = {i: len(words(t)) for i, t in long_rows}
    mix = mixing.mix_sources(df).collect()
    # quotas are whole blocks of 16 words, and the last block of each of the two shards may be short
    assert {r["doc_id"]: r["size"] for r in mix} == sizes and abs(sum(r["taken"] for r in mix) - sum(sizes.values())) <= 8 + 2 * 15


def test_long_texts_pieces(spark, long_rows):
    m = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r["doc_id"]: r for r in Q.digests(pieces.encode_pieces(spark.createDataFrame(long_rows, "doc_id long, text string"), PIECES)).collect()}
    for i, t in long_rows:
        ids = m.encode(t or "") + [2]
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(m.decode(ids).encode()).hexdigest()


def test_long_texts_token_files(spark, long_rows):
    t = Tokenizer.from_file(BYTES)
    got = {r["doc_id"]: bytes(r["ids"]) for r in token_files.token_files(spark.createDataFrame(long_rows, "doc_id long, text string"), BYTES).collect()}
    assert got == {i: np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4").tobytes() for i, x in long_rows}


def test_long_texts_quality_rules(spark, long_rows):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = {r["doc_id"]: tuple(r[c] for c in names) for r in quality_rules.quality_rules(spark.createDataFrame(long_rows, "doc_id long, text string")).collect()}
    assert got == {i: _rules(t) for i, t in long_rows}


def test_cover():
    assert substrings.covers() and not substrings.covers((0, 1, 2), 31)


def test_mixing(docs, corpus, empty):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(corpus) and mixing.mix_sources(empty).collect() == []
    total = sum(len(words(t)) for _, t, _ in corpus)
    sizes = collections.Counter()
    for _, t, s in corpus:
        sizes[s] += len(words(t))
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, full = {}, set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        target = {s: 3 * sizes[s] if s in full else rest * weight[s] / sum(weight[x] for x in names if x not in full) for s in names}
        over = {s for s in names if target[s] > 3 * sizes[s] + 1e-9}
        if not over:
            break
        full |= over
    taken = collections.Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6
    for s in names:
        assert abs(taken[s] - target[s]) <= 48 + 0.02 * target[s]
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs).collect()))


def test_mixed_documents_hold_what_is_taken(docs):
    unique = docs.where("doc_id is not null and doc_id != 14")
    plan = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(unique).collect()}
    out = mixing.mixed_documents(unique)
    n = collections.Counter()
    for r in out.collect():
        n[r["doc_id"]] += len(words(r["text"]))
    assert out.columns == docs.columns and {k: v for k, v in plan.items() if v} == dict(n)
    other = clashing(unique)
    named = mixing.mixed_documents(other)
    assert named.columns == other.columns and sorted(map(str, named.collect())) == sorted(map(str, clashing(out).collect()))
    assert mixing.mixed_documents(other.limit(0)).collect() == []


def test_mixed_documents_of_repeated_rows(spark):
    """Ids and texts that repeat in one source and in two: each source's words are those of its own plan."""
    rng = random.Random(4)
    t = prose(rng, 80)
    rows = [(1, t, "a"), (1, t, "c"), (1, t, "c"), (2, t, "b"), (None, t, "a"), (None, t, "a"), (None, t, None)] + [(k, prose(rng, 60), "abc"[k % 3]) for k in range(5, 30)]
    df = table(spark, rows)
    plan, n = collections.Counter(), collections.Counter()
    for r in mixing.mix_sources(df).collect():
        plan[r["doc_id"], r["size"], r["source"]] += r["taken"]
    for r in mixing.mixed_documents(df).collect():
        n[r["doc_id"], 80 if r["doc_id"] in (1, 2, None) else 60, r["source"]] += len(words(r["text"]))
    assert n == {k: v for k, v in plan.items() if v}
    assert plan[1, 80, "a"] != plan[1, 80, "c"]


def test_equal_rows_go_to_many_shards(spark):
    rows = [(None, "one two three four", "a")] * 300 + [(k, "five six", "a") for k in range(40)] + [(k, "five six", "b") for k in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    p = mixing._doc_plan(df, "doc_id", "text", "source", (5, 2, 1), 3, 17, 4, 50).select("rank", "shard", "size", "doc_id").collect()
    most = collections.Counter((r["rank"], r["shard"]) for r in p if r["doc_id"] is None)
    assert len(p) == len(rows) and len(most) > 10 and max(most.values()) <= 8 * 12
    got = mixing.mix_sources(df, block=4, shard_words=50).collect()
    taken, target = collections.Counter(), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 3 * r["size"]
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 0.1 * target[s] for s in target)
    again = mixing.mix_sources(df.repartition(7), block=4, shard_words=50).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_taken_by_brute_force(spark):
    rng = random.Random(9)
    rows = [(k, prose(rng, rng.choice([0, 1, 3, 20, 90])), rng.choice(["a", "b", "b", "b", "c", None])) for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    seed, block, words_a_shard = 17, 8, 700
    got = {r["doc_id"]: r for r in mixing.mix_sources(df, seed=seed, block=block, shard_words=words_a_shard).collect()}
    mix = {r["doc_id"]: r["m"] for r in df.select("doc_id", F.xxhash64(F.lit(seed), "doc_id", "text").alias("m")).collect()}
    size, names = {k: len(words(t)) for k, t, _ in rows}, sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))

    def deal(votes, seats):
        n = collections.Counter()
        for _ in range(seats):
            n[min((x for x in votes if votes[x]), key=lambda x: (-votes[x] / (2 * n[x] + 1), x))] += 1
        return n

    target = {names.index(s) + 1: got[k]["target"] for k, _, s in rows}
    seats = deal(target, round(sum(target.values()) / block))
    shards = collections.defaultdict(list)
    for k, _, s in rows:
        rank = names.index(s) + 1
        total = sum(size[i] for i, _, x in rows if x == s)
        shards[rank, mix[k] % max(1, -(-total // words_a_shard))].append(k)
    key = spark.createDataFrame(list(shards), "rank int, shard long").select("rank", "shard", F.xxhash64(F.lit(seed), "rank", "shard").alias("o"), F.xxhash64(F.lit(seed + 1), "rank", "shard").alias("s"))
    walk = {(r["rank"], r["shard"]): (r["o"], r["s"]) for r in key.collect()}
    quota = {rank: deal({sh: sum(size[k] for k in ids) for (r, sh), ids in shards.items() if r == rank}, seats[rank]) for rank in target}
    for (rank, shard), ids in shards.items():
        flow = [k for k in sorted(ids, key=lambda k: (mix[k], k, size[k])) for _ in range(size[k])]
        n = max(1, -(-len(flow) // block))
        passes, extra = divmod(min(quota[rank][shard], 3 * n), n)
        steps = [p % n for p in mixing.STEPS if 1 < p % n < n - 1]
        step = steps[walk[rank, shard][1] % len(steps)] if steps else 1
        taken = collections.Counter({k: passes * size[k] for k in ids})
        for j in range(n):
            if (j * step + walk[rank, shard][0]) % n < extra:
                taken.update(flow[j * block : (j + 1) * block])
        assert {k: got[k]["taken"] for k in ids} == {k: taken[k] for k in ids}


def test_shards_in_bunches(spark, docs, monkeypatch):
    before = mixing.mix_sources(docs, block=4, shard_words=100).collect()
    monkeypatch.setattr(mixing, "BUNCH", 3)
    after = mixing.mix_sources(docs, block=4, shard_words=100).collect()
    sums = [collections.Counter() for _ in range(2)]
    for n, rows in zip(sums, (before, after)):
        for r in rows:
            n[r["source"]] += r["taken"]
    assert all(abs(sums[0][s] - sums[1][s]) <= 200 for s in sums[0])


def test_sainte_lague_is_highest_quotients(spark):
    rng = random.Random(6)
    data = [(g, i, float(rng.choice([0, 1, 5, rng.randint(1, 1000)])), 37) for g in range(5) for i in range(9)] + [(9, 0, 0.0, 5)]
    got = {(r["g"], r["i"]): r["quota"] for r in mixing.sainte_lague(spark.createDataFrame(data, "g int, i int, v double, m long"), ["g"], ["i"], "v", "m").collect()}
    for g in range(5):
        q = sorted(((-v / (2 * k + 1), i) for gg, i, v, _ in data if gg == g and v for k in range(40)))[:37]
        n = collections.Counter(i for _, i in q)
        assert {i: got[(g, i)] for i in range(9)} == {i: n[i] for i in range(9)}


def test_token_files(docs, corpus, empty):
    t = Tokenizer.from_file(BYTES)
    rows = token_files.token_files(docs, BYTES).collect()
    got = sorted((r["start"], r["doc_id"], bytes(r["ids"])) for r in rows)
    want = sorted(((-1 if i is None else i), np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4").tobytes()) for i, x, _ in corpus)
    assert sorted(((-1 if d is None else d), b) for _, d, b in got) == want
    at = 0
    for start, _, b in got:
        assert start == at
        at += len(b) // 4
    order = [-1 if d is None else d for _, d, _ in got]
    assert order == sorted(order) and token_files.token_files(empty, BYTES).collect() == []


@pytest.mark.parametrize("kind", ["even", "hot", "heavy texts", "far apart", "one", "clustered"])
def test_shards_are_cut_by_bytes(spark, kind):
    rng = random.Random(5)
    ids = {"even": range(3000), "hot": [*range(1000), *[77] * 2000], "heavy texts": range(900), "far apart": [-(1 << 63), -(1 << 63) + 1, 0, (1 << 63) - 1] * 90, "one": [5] * 3000, "clustered": [10**15 + k for k in range(1500)] + [3, 10**18]}[kind]
    rows = [(i, 5000 if kind == "heavy texts" and i < 40 else rng.randint(1, 60)) for i in ids]
    df = spark.createDataFrame(rows, "id long, bytes long").repartition(3)
    total = sum(b for _, b in rows)
    for n in (1, 2, 7, 20):
        cuts = token_files.byte_cuts(df, n)
        assert len(cuts) == n - 1 and cuts == sorted(cuts)
        shards = token_files.Shards(cuts, 0)
        key = np.array([i for i, _ in rows], np.int64)
        at = shards.of(key, np.zeros(len(rows), bool), np.array([rng.getrandbits(64) - (1 << 63) for _ in rows], np.int64))
        held = np.bincount(at, [b for _, b in rows], shards.n)
        most = {"far apart": total / 4, "heavy texts": 5000}.get(kind, 0)
        assert at.max() < shards.n <= 2 * n + 1 and held.max() <= max(2.2 * total / n, 1.3 * most + total / n)
        assert all(at[i] <= at[j] for i, j in itertools.pairwise(np.argsort(key, kind="stable")) if key[i] != key[j])
    assert token_files.byte_cuts(df.limit(0), 4) == []


@pytest.mark.parametrize("top", [1, 1 << 8, 1 << 16, 1 << 24, 1 << 32])
def test_pack_round_trip(top):
    rng = np.random.default_rng(top)
    for n in (0, 1, 3, 4, 1001):
        x = rng.integers(0, top, n).astype(np.uint32)
        assert (token_files.unpack(*token_files.pack(x), n) == x).all()


def _rules(t):
    w = [x.decode() for x in words(t)]
    n = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    seen = [False] * len(w)
    for i in range(len(w) - 7):
        if n[tuple(w[i : i + 8])] > 1:
            seen[i : i + 8] = [True] * 8
    lines = [x for x in (t or "").split("\n") if WORD.search(x.encode())]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), sum(seen)


def test_quality_rules(spark, corpus, empty):
    more = [(50, "a b\n \n\t\n \na b\n\n", "a"), (51, "## $$ | <b> **\n|", "a"), (52, "one two three four five six seven eight nine " * 5, "a"), (53, "THE WORDS ARE LOUD " * 2 + "and no more than that is said in here by us all day", "a")]
    df = table(spark, corpus + more)
    got = collected(quality_rules.quality_rules(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
    want = []
    for i, t, _ in corpus + more:
        r = _rules(t)
        want.append(dict(zip(("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"), (i, *r, r[0] < 20 or 100 * r[4] > 30 * r[0]))))
    assert got == sorted(want, key=lambda r: str(sorted(map(str, r.items()))))
    assert quality_rules.quality_rules(empty).collect() == []
    assert not any(r["kept"] and r["base_failed"] for r in quality_rules.quality_rules(df).collect())


def test_language_model_base_and_lattice(docs, corpus, empty):
    c, n_docs = collections.Counter(), 0
    tokens = [(i, [x.lower() for x in words(t)] + [None]) for i, t, _ in corpus]
    out_of = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    for i, w in tokens:
        if not out_of(i):
            c.update(w)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), out_of(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)) for i, w in tokens)
    got = language_model.score_documents(docs, PIECES).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert language_model.score_documents(empty, PIECES).collect() == []


def test_language_model_sums_all_segmentations_of_documents(docs, corpus):
    trie = language_model.PieceTrie(PIECES)
    c, n_docs, place = collections.Counter(), 0, {p: i for i, p in enumerate(trie.pieces)}
    tokens = [[x.lower() for x in words(t)] for _, t, _ in corpus]
    for (i, _, _), w in zip(corpus, tokens):
        if zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1:
            c.update(w)
            n_docs += 1
    share = trie.before
    for _ in range(3):
        # expected uses of pieces, by sums of probabilities ahead of and behind each place
        used = np.zeros(len(share))
        for word, times in c.items():
            w = b" " + word
            edges = [(i, j, place[w[i:j]]) for j in range(1, len(w) + 1) for i in range(max(0, j - trie.longest), j) if w[i:j] in place]
            ahead, back = [1.0] + [0.0] * len(w), [0.0] * len(w) + [1.0]
            for i, j, k in edges:
                ahead[j] += ahead[i] * share[k]
            for i, j, k in sorted(edges, reverse=True):
                back[i] += back[j] * share[k]
            for i, j, k in edges:
                used[k] += times * ahead[i] * share[k] * back[j] / ahead[-1]
        end = (n_docs + 1) / (used.sum() + n_docs + 2)
        share = (0.98 * used / used.sum() + 0.02 * trie.before) * (1 - end)
    p = {x: float(share[i]) for x, i in place.items()}

    def brute(w):
        text, ways = b"".join(b" " + x for x in w), [0.0]
        for j in range(1, len(text) + 1):
            got = [ways[i] + math.log(p[text[i:j]]) for i in range(max(0, j - trie.longest), j) if text[i:j] in p]
            ways.append(max(got) + math.log(sum(math.exp(g - max(got)) for g in got)))
        return (ways[-1] + math.log(end)) / math.log(10)

    want = sorted(map(brute, tokens))
    for parts in (1, 13):
        got = language_model.score_documents(docs.repartition(parts), PIECES).collect()
        assert np.allclose(sorted(r["score"] for r in got), want, rtol=1e-6)


def test_language_model_of_long_words_and_texts(spark):
    long_word, long_text = "ab" * 1_000_000, "some words and more of them " * 350_000
    df = spark.createDataFrame([(1, long_word), (2, long_text), (3, "some words")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_model.score_documents(df, PIECES).collect()}
    assert got[1]["n_tokens"] == 2 and got[2]["n_tokens"] == 6 * 350_000 + 1 and got[3]["n_tokens"] == 3
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got.values())


def test_lattice_sums_all_segmentations():
    trie = language_model.PieceTrie(PIECES)
    rng = np.random.default_rng(0)
    p = rng.random(len(trie.pieces))
    p /= p.sum()
    at = {x: i for i, x in enumerate(trie.pieces)}

    def brute(w):
        ways = [0.0]
        for j in range(1, len(w) + 1):
            got = [ways[i] + math.log(p[at[w[i:j]]]) for i in range(max(0, j - trie.longest), j) if w[i:j] in at]
            ways.append(max(got) + math.log(sum(math.exp(g - max(got)) for g in got)))
        return ways[-1]

    some = [b"the", b"theretion", "çé漢".encode(), b"a", b"x" * 50, b"theretion" * 200]
    got = language_model.word_likelihoods(trie, np.log(p), some)
    assert np.allclose(got, [brute(b" " + w) for w in some])
    used = language_model.expected_pieces(trie, np.log(p), some, np.arange(1.0, len(some) + 1))
    assert np.allclose(used, sum(n * language_model._expected(trie, np.log(p), [w], np.ones(1)) for n, w in enumerate(some, 1)))
    assert np.isclose(sum(len(trie.pieces[i]) * used[i] for i in np.flatnonzero(used)), sum(n * (len(w) + 1) for n, w in enumerate(some, 1)))


def test_more_passes_fit_better(spark):
    """Training raises the likelihood of the training texts, and of those held out."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")

    def each(passes):
        n = collections.Counter()
        for r in language_model.score_documents(df, PIECES, passes=passes).collect():
            n[r["held_out"], "score"] += r["score"]
            n[r["held_out"], "tokens"] += r["n_tokens"]
        return [n[h, "score"] / n[h, "tokens"] for h in (False, True)]

    none, one, three = each(0), each(1), each(3)
    assert none[0] + 1 < one[0] < three[0] and none[1] + 1 < one[1] < three[1]


def restorer(words, n=4000):
    rng = random.Random(0)
    text = " ".join(rng.choice(words) for _ in range(n)).encode()
    return toxicity.Restorer(toxicity.letter_model(np.bincount(toxicity.letter_counts(text), minlength=toxicity.N_CLASSES**3)))


MEANT = ["the", "idiot", "was", "stupid", "and", "loser", "moron", "gone", "then", "other", "shit"]


@pytest.mark.parametrize(
    "written, meant",
    [("1d10t", "idiot"), ("i d i o t", "idiot"), ("$tupid", "stupid"), ("l00ser", "loser"), ("m0r0n", "moron"), ("stuuuupid", "stupid"), ("i.d.i.o.t", "idiot"), ("1 d 1 0 t", "idiot"), ("m o r 0 n", "moron"), ("id iot", "idiot"), ("1d i0t", "idiot"), ("mo ron", "moron"), ("stu p id", "stupid")]
    + [("i  d  i  o  t", "idiot"), ("m-o-r-0-n", "moron"), ("mor0n", "moron"), ("5h17", "shit"), ("l0000ser", "loser"), ("iddiiott", "idiot"), ("S*T*U*P*1*D!", "stupid"), ("!diot", "idiot")],
)
def test_restore(written, meant):
    assert restorer(MEANT)(f"the {written} was".encode()).decode() == f"the {meant} was"


def test_clean_text_is_its_own_reading():
    assert restorer(MEANT)(b"The gone was THEN 1999 and 3 items, 2.0.") == b"the gone was then 1999 and 3 items 2.0"


def test_best_reading_beats_all_readings():
    r = restorer(MEANT)
    rng = random.Random(4)

    def score(path):
        total, a, b = 0.0, 0, 0
        for _, codes, cost in path:
            total += cost
            for k in codes:
                if k or b:
                    total += r.log_p[(a * 64 + b) * 64 + k]
                    a, b = b, k
        return total + (r.log_p[(a * 64 + b) * 64] if b else 0.0)

    for _ in range(300):
        span = "".join(rng.choice("iidot1100$. -s@tté") for _ in range(rng.randint(1, 8)))
        lattice = r.lattice(span)
        best, text = r.best(lattice)
        paths = list(itertools.product(*lattice))
        assert abs(best - max(map(score, paths))) < 1e-9
        assert any("".join(x for x, _, _ in p) == text and abs(score(p) - best) < 1e-9 for p in paths)


def test_long_spans_are_restored_whole():
    r = restorer(MEANT)
    assert r(b"i d i o t " * 20_000).split().count(b"idiot") >= 1 and r(b"m0r0n" * 60_000) == b"moron" * 60_000


def test_classifiers(spark, docs, corpus, empty):
    rng = random.Random(8)
    rows, marks = [], []
    for i in range(600):
        bad, rude = rng.random() < 0.3, rng.random() < 0.3
        t = prose(rng, rng.randint(20, 60))
        t = " ".join(w + "%%%" for w in t.split()) if bad else t
        rows.append((i, t + (" grolf" + rng.choice(["an", "in", "ou"]) if rude else ""), "a"))
        marks.append((i, int(not bad), int(rude)))
    df, labels = table(spark, rows), spark.createDataFrame(marks + [(9999, 1, 1), (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    truth = {i: (q, t) for i, q, t in marks}
    for k, f in ((0, quality_classifier.score_quality), (1, toxicity.score_toxicity)):
        got = f(df, labels).collect()
        held = [r for r in got if r["held_out"]]
        assert len(got) == 600 and all(0 <= r["score"] <= 1 for r in got)
        assert sum(r["predicted"] == truth[r["doc_id"]][k] for r in held) / len(held) > 0.9
        odd = f(docs, labels).collect()
        assert len(odd) == len(corpus) and f(empty, labels).collect() == []
        assert {r["score"] for r in f(docs, labels.limit(0)).collect()} == {0.5}
    for given in (docs, df.withColumn("doc_id", F.when(F.col("doc_id") > 5, F.col("doc_id") % 90)).unionByName(docs)):
        gone = collections.Counter(r["text"] or "" for r, s in zip(given.select("text").collect(), toxicity.train_toxicity(given, labels).scores([(r["text"] or "").encode() for r in given.select("text").collect()])) if s >= 0.5)
        clean = toxicity.clean_documents(given, labels)
        assert clean.columns == given.columns and toxicity.clean_documents(given.limit(0), labels).collect() == []
        left = collections.Counter(map(str, given.collect()))
        left.subtract(map(str, clean.collect()))
        assert min(left.values()) == 0 and collections.Counter(r["text"] or "" for r in given.collect() if left[str(r)] > 0) == gone


def test_classifier_gradient_and_training():
    rng = np.random.default_rng(5)
    vectors, classes, share, const = rng.normal(size=(6, 3)), rng.normal(size=(2, 3)), rng.random(6), np.array([0.3, -0.4])
    share /= share.sum()
    loss, by_vectors, by_classes = quality_classifier.gradient(vectors, classes, const, share, 1)
    for x, g in ((vectors, by_vectors), (classes, by_classes)):
        for i in np.ndindex(*x.shape):
            up, down = (quality_classifier.gradient(*[y + e * (np.arange(y.size).reshape(y.shape) == np.ravel_multi_index(i, y.shape)) if y is x else y for y in (vectors, classes)], const, share, 1)[0] for e in (1e-6, -1e-6))
            assert abs((up - down) / 2e-6 - g[i]) < 1e-6
    docs = [(np.array([0, k]), np.array([0.25, 0.75]), int(k > 5)) for k in rng.integers(1, 10, 60)]
    # the same statement with dense documents and no shortcut
    r = np.random.default_rng(3)
    v, c, step = r.uniform(-0.25, 0.25, (10, 4)), np.zeros((2, 4)), 0
    b = np.log([1 + sum(1 - y for *_, y in docs), 1 + sum(y for *_, y in docs)])
    for _ in range(12):
        for i in r.permutation(60):
            x = np.zeros(10)
            x[docs[i][0]] = docs[i][1]
            p = np.exp(c @ (x @ v) + b) / np.exp(c @ (x @ v) + b).sum() - np.eye(2)[docs[i][2]]
            lr = 0.4 * (1 - step / 720)
            v, c, step = v - lr / (x @ x) * np.outer(x, p @ c), c - lr * np.outer(p, x @ v), step + 1
    got, constant = quality_classifier.train(docs, dim=4, buckets=10)
    assert np.allclose(got, v @ (c[1] - c[0])) and (got[6:] > got[1:6].max()).all() and np.isclose(constant, b[1] - b[0])
    none, zero = quality_classifier.train([], buckets=10)
    assert (none == 0).all() and zero == 0


def _said(n):
    """The bucket of a 64-bit number."""
    n ^= n >> 29
    return (n * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 46


def test_features_are_of_words_runs_and_characters():
    flat = lambda t: np.sort(np.concatenate(quality_classifier.features(t.encode())))
    t = "añb aé b"
    want = []
    for n in (1, 2, 3):
        want += [_said((int(h) + n) & (1 << 64) - 1) for h in substrings.window_hashes(substrings.word_hashes([w.encode() for w in t.split()]), n)]
    for n in (2, 3, 4):
        for i in range(len(t) - n + 1):
            h = ord(t[i])
            for c in t[i + 1 : i + n]:
                h = h * 0x01000193 & 0xFFFFFFFF ^ ord(c)
            want.append((h * 0x9E3779B1 & 0xFFFFFFFF) >> 14)
    assert flat(t).tolist() == sorted(want) and max(want) < quality_classifier.BUCKETS
    assert len(flat("")) == 0
    long = "çé" * 2_200_000
    assert len(flat(long)) == 1 + 3 * len(long) - 6


def test_no_bucket_is_of_repeated_words_alone():
    """Runs of one word repeated are as far apart as any other runs, and a run's order counts."""
    runs = {w: [tuple(f.tolist()) for f in quality_classifier.features(f"{w} {w} {w}".encode())[2:4]] for w in ("foo", "bar", "the", "x")}
    seen = [b for r in runs.values() for f in r for b in set(f)]
    assert len(set(seen)) == len(seen) == 8
    ab, ba = (quality_classifier.features(t)[2][0] for t in (b"foo bar", b"bar foo"))
    assert ab != ba


def test_quality_score_by_plain_sums(spark, docs):
    """Scores are those of the trained weights over the texts' features; empty texts score the share of label 1."""
    rng = random.Random(3)
    rows = [(i, prose(rng, 12) + (" zz zz" if i % 3 else ""), "a") for i in range(90)] + [(200, "", "a"), (201, None, "a"), (202, "long " * 200_000, "a")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(90)], "doc_id long, quality int")
    sample = sorted((i, t, int(i % 3 > 0)) for i, t, _ in rows[:90] if zlib.crc32(str(i).encode()) % 5)
    counted = []
    for _, t, y in sample:
        n = np.bincount(np.concatenate(quality_classifier.features(t.encode())))
        counted.append((np.flatnonzero(n), (n[n > 0] / n.sum()).astype(np.float32).astype(float), y))
    weight, constant = quality_classifier.train(counted)
    for r in quality_classifier.score_quality(table(spark, rows), labels).collect():
        f = np.concatenate(quality_classifier.features((dict((i, t) for i, t, _ in rows)[r["doc_id"]] or "").encode()))
        assert math.isclose(r["score"], 1 / (1 + math.exp(-(weight[f].mean() if len(f) else 0) - constant)), rel_tol=1e-6)
        if r["doc_id"] in (200, 201):
            assert math.isclose(r["score"], (1 + sum(y for *_, y in sample)) / (2 + len(sample)))


@pytest.mark.parametrize("name, label, least", [("op6_quality_classifier", "quality", 0.93), ("op10_toxicity", "toxic", 0.93)])
def test_held_out_accuracy(spark, name, label, least):
    d = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in Q.QUERIES[name](spark, d).collect()}
    truth = [(got[r["doc_id"]], r[label]) for r in spark.read.parquet(f"{d}/labels.parquet").where(f"{label} is not null").collect()]
    held = [(r["predicted"], y) for r, y in truth if r["held_out"]]
    right, most = sum(p == y for p, y in held) / len(held), max(collections.Counter(y for _, y in held).values()) / len(held)
    assert right >= least and right > most


def test_labelled_sample_is_bounded_by_rows(spark):
    docs = spark.createDataFrame([(i % 5, f"text {i}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)] + [(3, 0), (None, 1), (77, 1)], "doc_id long, quality int")
    got = labelled.labelled_sample(docs, labels, "quality", 4).collect()
    assert len(got) == len({r["doc_id"] for r in got}) <= 4 and all(r["label"] == r["doc_id"] % 2 for r in got)


def _disguised(rng, word):
    """A word as it may be written to slip through: look-alikes, a letter again and again, signs or spaces between."""
    alike = {"o": "0", "i": "1", "e": "3", "a": "4@", "s": "5$", "t": "7", "b": "8", "g": "9"}
    how = rng.randrange(5)
    if how == 4:  # a space somewhere, and a look-alike
        at = rng.randrange(2, len(word) - 1)
        word = "".join(alike[c][0] if c in "oie" and rng.random() < 0.5 else c for c in word)
        return word[:at] + " " + word[at:]
    if how == 0:
        return "".join(rng.choice(alike[c]) if c in alike else c for c in word)
    if how == 1:
        at = rng.randrange(len(word))
        return word[:at] + word[at] * rng.randint(3, 6) + word[at + 1 :]
    return ("." if how == 2 else " ").join(word)


def test_restoring_catches_disguised_words(spark):
    """Held-out toxic texts whose telling words are disguised: at as many false alarms, the decoder finds far more."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    scorer = toxicity.train_toxicity(docs, labels)
    held = docs.where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0").join(labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id")
    rows = [(r["text"] or "", r["toxic"]) for r in held.select("text", "toxic").collect()]
    telling = {m for m in scorer.evidence if not m.endswith(b"-")}
    rng = random.Random(2)
    hidden, clean = [], [t.encode() for t, y in rows if not y]
    for t, y in rows:
        if y:
            change = lambda m: _disguised(rng, m[0]) if m[0].encode() in telling or any(m[0][:k].encode() + b"-" in scorer.evidence for k in range(3, 9)) else m[0]
            hidden.append(re.sub(r"[a-z]{4,}", change, t.lower()).encode())

    class AsIs:
        tokens = staticmethod(lambda text: set(text.lower().split()))
        token = staticmethod(lambda t: t)

    def caught(s):
        alarm = sorted(s.scores(clean))[-max(1, len(clean) // 100)]
        return sum(x > alarm for x in s.scores(hidden)) / len(hidden)

    plain = toxicity.Scorer(scorer.model, scorer.evidence, np.array(scorer.weights))
    plain.found = toxicity.Evidence(scorer.evidence, AsIs())
    with_, without = caught(scorer), caught(plain)
    print(f"disguised toxic texts caught: {with_:.3f} restored, {without:.3f} as they are, of {len(hidden)}")
    assert with_ >= without + 0.3 and with_ >= 0.7


def test_toxicity_learns_as_stated(spark):
    """Evidence and logistic weights against a plain statement over whole sets of words."""
    rng = random.Random(12)
    given = [(i, prose(rng, rng.randint(0, 40)) + (" grolf" + rng.choice(["an", "in", "ou"]) if i % 3 == 1 else ""), int(i % 3 == 1 or i % 50 == 0)) for i in range(400)]
    scorer = toxicity.train_toxicity(table(spark, [(i, t, "a") for i, t, _ in given]), spark.createDataFrame([(i, y) for i, _, y in given], "doc_id long, toxic int"))
    r = toxicity.Restorer(scorer.model)
    docs = [({w for x in r.tokens(t.encode()) for w in toxicity.words_of(r.token(x))}, y) for i, t, y in given if zlib.crc32(str(i).encode()) % 5]

    def evidence(docs):
        n = collections.Counter(y for _, y in docs)
        held = collections.Counter((m, y) for words, y in docs for m in {m for w in words for m in toxicity.marks(w)})
        odds = {m: math.log((k + 0.5) / (n[1] + 1)) - math.log((held[m, 0] + 0.5) / (n[0] + 1)) for (m, y), k in held.items() if y and k >= max(4, n[1] / 100)}
        return {m: w for m, w in odds.items() if w > 1.5}

    assert scorer.evidence == evidence(docs) and b"grol-" in scorer.evidence
    half = np.random.default_rng(3).permutation(len(docs)) % 2
    found = [toxicity.Evidence(evidence([d for d, k in zip(docs, half) if k != h])) for h in (0, 1)]
    x, y, w = np.array([found[h].features(words) for (words, _), h in zip(docs, half)]), np.array([y for _, y in docs]), np.array(scorer.weights)
    assert np.abs(x.T @ (1 / (1 + np.exp(-(x @ w))) - y) + 1e-2 * w).max() < 1e-4


def test_toxicity_keeps_words_off_the_driver(spark):
    """What the driver's Python holds while it learns doesn't grow with the words of the labelled texts."""
    rng = np.random.default_rng(6)
    letters = rng.integers(97, 123, (240, 3000, 8), dtype=np.uint8)
    rows = [(i, " ".join(w.tobytes().decode() for w in x) + " grolfan" * (i % 2), "a") for i, x in enumerate(letters)]
    docs = table(spark, rows).select("doc_id", "text").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(240)], "doc_id long, toxic int")
    docs.count()  # what sends the rows is over
    tracemalloc.start()
    try:
        scorer = toxicity.train_toxicity(docs, labels)
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    print(f"the driver's Python held {peak:.0f} MB at most")
    assert b"grolfan" in scorer.evidence and peak < 40
