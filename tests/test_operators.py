"""Rules on small inputs, against plain Python statements of them."""

import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from easel.functions import geometry as G
from easel.functions import names as N
from easel.functions import pixels as PX
from easel.functions import tags as T
from easel.functions import urls as U
from easel.operators import boxes as B
from easel.operators import clusters as K
from easel.operators import collect as C
from easel.operators import duplicates as D
from easel.operators import image_jobs as J
from easel.operators import posts as P
from easel.operators import scores as M
from easel.operators import tags as O
from easel.plans import compose as X
from easel.plans import image_queries as Q
from easel.sources import images as S


def png(path, width, height, pixel, alpha=False):
    raw = b"".join(b"\0" + b"".join(bytes(pixel(x, y)) for x in range(width)) for y in range(height))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", width, height, 8, 6 if alpha else 2, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture()
def folder(tmp_path):
    png(tmp_path / "source.png", 120, 80, lambda x, y: (7 * x % 256, 11 * y % 256, x * y % 256))
    png(tmp_path / "clear.png", 20, 10, lambda x, y: (255, 0, 0, 0), True)
    (tmp_path / "bad.png").write_bytes(b"not an image")
    (tmp_path / "notes.md").write_text("x")
    (tmp_path / "source.txt").write_text(" a, b \n")
    return tmp_path


def test_read_images(spark, folder):
    index = {r["name"] for r in S.read_image_index(spark, str(folder)).collect()}
    assert index == {"source.png", "clear.png", "bad.png"}
    got = {r["file"].split("/")[-1]: (r["ok"], r["width"], r["height"], r["channels"]) for r in S.read_images(spark, str(folder)).collect() if r["file"].endswith("png")}
    assert got["source.png"] == (True, 120, 80, 3) and got["clear.png"] == (True, 20, 10, 4) and got["bad.png"][0] is False


def test_image_jobs_on_files(spark, folder):
    images = S.read_images(spark, str(folder)).where("file like '%png'")
    size = lambda df: {r["file"].split("/")[-1]: (r["ok"], r["width"], r["height"]) for r in df.collect()}
    assert size(J.mirror(images))["source.png"] == (True, 120, 80)
    assert size(J.center_crop(images, 1, 1))["source.png"] == (True, 80, 80)
    assert size(J.resize(images, 60, 60))["source.png"] == (True, 60, 60)
    assert size(J.mirror(images))["bad.png"] == (False, None, None)
    flat = {r["file"].split("/")[-1]: r for r in J.flatten_alpha(images).collect()}
    assert set(flat["clear.png"]["data"]) == {255} and flat["source.png"]["error"] == "skipped"
    same = {r["file"]: bytes(r["data"]) for r in images.where("ok and channels = 3").collect()}
    for job in (J.perspective(images, 0.0), J.blur_noise(images, 0, 0)):
        for r in job.where("ok").collect():
            if r["file"] in same:
                assert bytes(r["data"]) == same[r["file"]]
    assert J.cutout(images, 2, 0.3).collect() == J.cutout(images, 2, 0.3).collect()
    with pytest.raises(ValueError):
        J.flatten_alpha(images, "transparent")


def test_signatures_of_files(spark, folder):
    got = {r["file"].split("/")[-1]: r for r in J.signatures(S.read_images(spark, str(folder)).where("file like '%png'")).collect()}
    assert len(got["source.png"]["dhash"]) == 4 and abs(sum(x * x for x in got["source.png"]["hist"]) - 1) < 1e-9


def test_sidecars(spark, folder, tmp_path, rows):
    df = S.read_sidecars(spark, S.read_image_index(spark, str(folder)), str(folder))
    assert {(r["name"], r["text"]) for r in df.collect()} == {("source.png", "a, b"), ("clear.png", ""), ("bad.png", "")}


def test_vocab(spark, tmp_path, rows):
    (tmp_path / "v.csv").write_text("name,category\na,0\nb,4\nc,odd\n")
    (tmp_path / "i.json").write_text('{"10": "x", "2": {"name": "y", "category": "rating"}}')
    (tmp_path / "m.json").write_text('{"idx_to_tag": {"1": "p", "0": "q"}, "tag_to_category": {"p": "Character"}}')
    assert rows(S.read_vocab(spark, str(tmp_path / "v.csv"), "csv")) == [(0, "a", 0), (1, "b", 4), (2, "c", 0)]
    assert rows(S.read_vocab(spark, str(tmp_path / "i.json"), "index")) == [(0, "y", 9), (1, "x", 0)]
    assert rows(S.read_vocab(spark, str(tmp_path / "m.json"), "mapping")) == [(0, "q", 0), (1, "p", 4)]


def test_quarantine_names(spark, rows):
    df = spark.createDataFrame([("d/photo.png", 1), ("d/ok.png", 0)], "file string, bad int")
    taken = spark.createDataFrame([("d/del/photo.png",), ("d/del/photo_2.png",)], "file string")
    kept, gone = S.quarantine(df, F.col("bad") == 1, existing=taken)
    assert rows(kept, "file") == [("d/ok.png",)] and rows(gone, "target") == [("d/del/photo_3.png",)]


def test_resolution_example(spark, rows):
    df = spark.createDataFrame([("a", 511, 9), ("b", 512, 9), ("n", None, 9)], "file string, width int, height int")
    assert rows(G.resolution_filter(df, 512), "file", "filtered") == [("a", True), ("b", False), ("n", None)]


def test_collisions_with_generated_names(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(["a.png", "a_1.png", "a.png", "a.png", "b"])], "pos int, name string")
    got = [r["unique_name"] for r in N.resolve_collisions(df).collect()]
    assert len(set(got)) == 5 and {"a.png", "a_1.png", "b"} <= set(got)


@pytest.mark.parametrize(("link", "want"), [
    ("/a.png", "https://h.test/a.png"), ("b.jpg#x", "https://h.test/p/b.jpg"), ("../c", "https://h.test/c"), ("./d/../e", "https://h.test/p/e"),
    ("//x.test/y", "https://x.test/y"), ("?q=1", "https://h.test/p/?q=1"), ("data:image/png;base64,x", None), ("javascript:x()", None), ("mailto:a@b", None),
    ("  ", None), (None, None), ("a&amp;b", "https://h.test/p/a&b"), ("http://z.test", "http://z.test/"),
])
def test_normalize_url(spark, link, want):
    df = spark.createDataFrame([(link, "https://h.test/p/")], "l string, b string")
    assert df.select(U.normalize_url(F.col("l"), F.col("b")).alias("u")).first()["u"] == want


def test_candidates_of_a_page(spark):
    html = """<img src="/a.png" data-src="b.jpg#x"><img srcset="c.webp 1x, d.webp 2x"><meta property="og:image" content="https://h.test/e.png"><link rel="icon" href="f.ico"><p style="background:url('g.gif')"></p> https://h.test/h.bmp"""
    df = spark.createDataFrame([(1, "https://h.test/p/", html), (2, "https://h.test/", None)], "page_id int, url string, html string")
    got = [(r["url"], r["kind"]) for r in C.extract_candidates(df).orderBy("rank").collect()]
    base = "https://h.test/"
    assert got == [(base + "a.png", "page"), (base + "p/b.jpg", "page"), (base + "p/c.webp", "page"), (base + "p/d.webp", "page"), (base + "e.png", "meta"), (base + "p/g.gif", "style"), (base + "h.bmp", "inline")]


def test_posts(spark):
    raw = '{"id":1,"file_url":"//cdn/x.png","tag_string":"a_b c","tag_string_artist":"z y","score":{"total":5},"rating":"g"}'
    df = spark.createDataFrame([("danbooru", raw), ("other", "not json"), ("other", None)], "site_kind string, raw string")
    got = P.normalize_posts(df).collect()
    assert tuple(got[0][c] for c in ("id", "url", "artist", "tags", "score", "rating")) == ("1", "https://cdn/x.png", "z", "a b,c", 5, "g")
    assert got[1]["id"] == "" and got[2]["score"] == 0


def _stars(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    while any(near.values()):
        c = max(near, key=lambda n: (len(near[n]), -n))
        taken = {c} | near[c]
        out |= dict.fromkeys(taken, c)
        near = {n: m - taken for n, m in near.items() if n not in taken}
    return out


@pytest.mark.parametrize("edges", [[(1, 2), (2, 3)], [(1, 2), (2, 3), (3, 4)], [(1, 2), (2, 3), (3, 4), (4, 5), (4, 6)], []])
def test_star_groups_fixtures(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r["id"]: r["group"] for r in D.star_groups(df).collect()} == _stars(edges)


def test_star_groups_and_components_random(spark):
    rng = random.Random(4)
    edges = [(g * 100 + a, g * 100 + b) for g in range(6) for a in range(12) for b in range(a + 1, 12) if rng.random() < 0.18]
    df = spark.createDataFrame([*edges, edges[0], (7, 7)], "a long, b long")
    assert {r["id"]: r["group"] for r in D.star_groups(df).collect()} == _stars(edges)
    low = {n: n for e in edges for n in e}
    for _ in range(20):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    assert {r["id"]: r["component"] for r in D.connected_components(df).collect()} == low


def test_links_within_tasks_keep_components(spark):
    from easel.plans.components import contracted

    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(5, 5), (None, 3), (4, None)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    few = [(r["a"], r["b"]) for r in contracted(df).collect()]
    both = [{r["id"]: r["component"] for r in D.connected_components(x).collect()} for x in (df, df.selectExpr("cast(a as string) a", "cast(b as string) b"))]
    low = {n: n for e in edges[:220] for n in e if e[0] != e[1]}
    for _ in range(300):
        for a, b in edges[:220]:
            if a != b:
                low[a] = low[b] = min(low[a], low[b])
    assert both[0] == low and len(few) <= 3 * len(low) and all(a < b for a, b in few)
    assert {int(k) for k in both[1]} == set(low)


def test_star_groups_long_chain(spark):
    df = spark.range(1999).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["id"]: r["group"] for r in D.star_groups(df).collect()} == _stars([(i, i + 1) for i in range(1999)])


@pytest.mark.parametrize("most", [0, 6])
def test_star_groups_rounds_and_components(spark, most):
    rng = random.Random(9)
    edges = [(g * 100 + a, g * 100 + b) for g in range(5) for a in range(4 + 5 * (g % 2)) for b in range(a + 1, 4 + 5 * (g % 2)) if rng.random() < 0.4]
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r["id"]: r["group"] for r in D.star_groups(df, most=most).collect()} == _stars(edges)


def test_flagship_verifies(spark):
    """Pairs, verification and groups from the images' signatures, all pairs one after another."""
    from easel.plans.pixel_queries import framed

    d = "/root/testdata/sf0.01"
    rows = [(int(r["file"]), r["dhash"], r["phash"], np.array(r["hist"])) for r in J.signatures(Q.saved_again(framed(spark, d))).collect()]
    bits = lambda a, b: sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a, b))
    by_hash = [(r, s) for r in rows for s in rows if r[0] < s[0] and bits(r[1], s[1]) <= 40]
    linked = []
    for r, s in by_hash:
        x, y = r[3] - r[3].mean(), s[3] - s[3].mean()
        if bits(r[2], s[2]) <= 40 and (x @ y) / np.sqrt((x @ x) * (y @ y)) >= 0.5:
            linked.append((r[0], s[0]))
    groups = _stars(linked)
    got = Q.QUERIES["flagship_dedup"](spark, d).collect()
    assert linked and {r["id"]: r["group"] for r in got if r["group"] is not None} == groups
    assert {r["id"] for r in got if r["action"] == "review"} == {i for i, g in groups.items() if i != g}
    assert {r["id"] for r in got if r["similarity"] is not None} == set(groups) and len(got) == len(rows)


@pytest.mark.parametrize("threshold", [3, 20])
def test_hamming_pairs(spark, threshold):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(20)]
    h = base + [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base] + [0, 0, (1 << 64) - 1]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(i, [signed(x)]) for i, x in enumerate(h)] + [(99, None)], "id long, hash array<bigint>")
    want = {(i, j) for i in range(len(h)) for j in range(i + 1, len(h)) if (h[i] ^ h[j]).bit_count() <= threshold}
    got = [(r["a"], r["b"]) for r in D.hamming_pairs(df, threshold).collect()]
    assert set(got) == want and len(got) == len(want)


def test_rank_quality_gaps(spark):
    cols = "group long, file string, score double, area long, sharpness double, bytes_per_pixel double, file_size long, has_alpha boolean, format string"
    data = [(1, f, s, 100, 1.0, 1.0, 5, False, "png") for f, s in (("a", 80.0), ("b", 74.0), ("c", 75.0))]
    got = {r["file"]: r["action"] for r in D.rank_quality(spark.createDataFrame(data, cols)).collect()}
    assert got == {"a": "keep", "b": "remove", "c": "review"}


def test_nms(spark):
    box = lambda x, s: (float(x), 0.0, float(x) + 10, 10.0, s)
    df = spark.createDataFrame([([box(0, 0.9), box(1, 0.95), box(30, 0.5), box(30, 0.5)],), ([],)], "boxes array<struct<x1:double,y1:double,x2:double,y2:double,score:double>>")
    got = [[(b["x1"], b["score"]) for b in r["k"]] for r in df.select(B.nms(F.col("boxes"), 0.45).alias("k")).collect()]
    assert got == [[(1.0, 0.95), (30.0, 0.5)], []]


def test_person_crops(spark):
    persons = spark.createDataFrame([("a", 0, (10.0, 10.0, 60.0, 90.0), 100, 100)], "file string, person int, box struct<x1:double,y1:double,x2:double,y2:double>, width int, height int")
    parts = spark.createDataFrame([("a", 0, "head", (20.0, 0.0, 40.0, 20.0, 0.5)), ("a", 0, "head", (0.0, 0.0, 5.0, 5.0, 0.2))], "file string, person int, kind string, box struct<x1:double,y1:double,x2:double,y2:double,score:double>")
    got = {(r["kind"], tuple(r["box"]), r["number"]) for r in B.person_crops(persons, parts).collect()}
    assert got == {("full", (10, 10, 60, 90), "0000"), ("head", (15, 0, 45, 25), "0001")}


def test_geometric_verify(spark):
    rng = random.Random(2)
    pts = [(rng.uniform(0, 300), rng.uniform(0, 200)) for _ in range(30)]
    rows = [(1, 2, x, y, 1.2 * x + 5, 0.8 * y - 3) for x, y in pts] + [(1, 3, x, y, rng.uniform(0, 300), rng.uniform(0, 300)) for x, y in pts]
    got = J.geometric_verify(spark.createDataFrame(rows, "a int, b int, xa double, ya double, xb double, yb double")).collect()
    assert [(r["a"], r["b"], r["inliers"]) for r in got] == [(1, 2, 30)]
    h = got[0]["h"]
    ok = spark.range(1).select(D.valid_homography(F.array(*[F.lit(x) for x in h]), F.lit(300), F.lit(200)).alias("ok")).first()["ok"]
    assert ok and abs(h[0] - 1.2) < 1e-6


def test_clusters_of_blobs(spark):
    rng = random.Random(3)
    data = [(i, [(10.0 + i) * (i % 3 == k) + rng.gauss(0, 0.1) for k in range(4)]) for i in range(60)] + [(60, None)]
    df = spark.createDataFrame(data, "id long, feature array<double>")
    for got in (K.kmeans(df, 3), K.density_cluster(df, 10, 0.5, dims=3)):
        labels = {r["id"]: r["group"] for r in got.collect()}
        assert labels[60] is None and len({labels[i] for i in range(60)}) == 3
        assert all(labels[i] == labels[i % 3] for i in range(60))
    assert K.kmeans(df.limit(1), 5).first()["group"] == 0


def test_scores(spark):
    df = spark.createDataFrame([(["masterpiece", "low"], [0.5, 0.5]), ([], [])], "l array<string>, p array<double>")
    assert [r["s"] for r in df.select(M.aesthetic_score(F.col("l"), F.col("p")).alias("s")).collect()] == [6.2, 0.0]
    assert [tuple(r["t"]) for r in df.select(M.top_label(F.col("l"), F.col("p")).alias("t")).collect()] == [("masterpiece", 0.5), ("", 0.0)]
    vocab = spark.createDataFrame([(0, "a_b", 0), (1, "c", 0), (2, "hero", 4), (3, "safe", 9)], "idx int, name string, category int")
    tags = M.select_tags(spark.createDataFrame([(1, [0.35, 0.3499, 0.85, 0.01]), (2, None)], "id int, probs array<double>"), vocab)
    got = {r["id"]: r["t"] for r in tags.select("id", M.tag_string(True).alias("t")).collect()}
    assert got == {1: "hero, a b, safe", 2: ""}


def test_batch_score_isolates_rows(spark):
    def make():
        def predict(x):
            if (x[:, 0] < 0).any():
                raise ValueError("negative")
            return x * 2

        return predict

    df = spark.createDataFrame([(1, [1.0]), (2, [-1.0]), (3, [3.0])], "id int, feature array<double>")
    assert {r["id"]: (r["scores"], r["ok"], r["error"]) for r in M.batch_score(df, make).collect()} == {1: ([2.0], True, None), 2: (None, False, "negative"), 3: ([6.0], True, None)}


def test_tags(spark):
    one = lambda c: spark.createDataFrame([("a, b",)], "t string").select(c.alias("x")).first()["x"]
    t = F.col("t")
    assert one(T.append_tags(t, ["b", "c"])) == "a, b, c" and one(T.prepend_tags(t, ["a"])) == "a, b"
    assert one(T.replace_tag(T.replace_tag(t, "a", "z"), "a", "z")) == "z, b" and one(T.remove_tag(t, "b")) == "a"


def test_changed_rows_falls_back(spark, rows):
    df = O.edit(spark.createDataFrame([("a", "x"), ("b", " ")], "file string, text string"), lambda c: c)
    assert rows(O.changed_rows(df), "file") == [("a",)]
    assert O.target_rows(df, df.limit(0)).count() == 2
    none = O.assign_round_robin(df.withColumn("pos", F.lit(1)), [{"name": "a"}])
    assert {r["error"] for r in none.collect()} == {"no usable config"}


def test_pipeline_rejects_cycles(spark):
    with pytest.raises(ValueError):
        X.Pipeline([("a", lambda x: x, ["b"]), ("b", lambda x: x, ["a"])], ["a"])
    df = spark.createDataFrame([("a", True), ("b", None)], "file string, ok boolean")
    out, seen = X.observed(df)
    out.collect()
    assert seen.get == {"ok": 1, "failed": 1, "total": 2}


def test_ledger_stream_replays_and_goes_on(spark, tmp_path):
    from easel.streaming.ledger import ledger_stream, read_ledger

    at = lambda x: f"file://{tmp_path}/{x}"
    schema = spark.createDataFrame([], "id long, good boolean").schema
    run = lambda c: ledger_stream(spark, at("in"), schema, at("ledger"), at(c), lambda df: df.withColumn("ok", F.col("good")), at("out"))
    spark.createDataFrame([(1, True), (2, False), (1, True), (None, True)], schema).write.parquet(at("in"))
    run("c1")
    assert sorted(r["id"] for r in read_ledger(spark, at("ledger")).collect()) == ["1"]
    spark.createDataFrame([(2, True), (3, True)], schema).write.mode("append").parquet(at("in"))
    run("c1")
    run("c2")
    out = sorted((r["id"], r["ok"]) for r in spark.read.parquet(at("out")).collect())
    assert sorted(r["id"] for r in read_ledger(spark, at("ledger")).collect()) == ["1", "2", "3"]
    assert [x for x in out if x[1]] == [(1, True), (2, True), (3, True)]


def test_hamming_pairs_of_all_kinds(spark):
    rng = np.random.default_rng(3)
    for words, threshold in ((1, 3), (1, 12), (1, 20), (4, 10), (4, 40), (2, 7)):
        h = rng.integers(-(1 << 63), 1 << 63, (60, words))
        for i in range(1, 60, 2):  # near copies, the sign bit among those that differ
            h[i] = h[i - 1]
            for b in rng.choice(64 * words, rng.integers(0, threshold + 3), replace=False):
                h[i, b // 64] ^= np.int64(np.uint64(1) << np.uint64(b % 64))
        h[58] = h[59]
        rows = [(i, [int(x) for x in r]) for i, r in enumerate(h)] + [(None, [0] * words), (99, None)]
        far = np.bitwise_count((h[:, None] ^ h[None]).view(np.uint64)).sum(2)
        want = sorted((i, j, int(far[i, j])) for i in range(60) for j in range(i + 1, 60) if far[i, j] <= threshold)
        got = D.hamming_pairs(spark.createDataFrame(rows, "id long, hash array<bigint>"), threshold, words=words).collect()
        assert sorted((r["a"], r["b"], r["dist"]) for r in got) == want


def test_content_box_follows_strips(spark):
    rng = np.random.default_rng(8)
    images = []
    for top, bottom, left, right, h, w in ((0, 0, 0, 0, 80, 90), (20, 15, 0, 30, 100, 130), (5, 0, 0, 0, 100, 100), (45, 45, 40, 40, 100, 100), (20, 20, 20, 20, 63, 100), (0, 40, 0, 0, 70, 64)):
        x = np.full((h, w, 3), 220, np.uint8)
        x[top : h - bottom, left : w - right] = rng.integers(0, 256, (h - top - bottom, w - left - right, 3))
        images.append(x)
    images.append(np.full((70, 70, 3), 9, np.uint8))
    rows = [(str(i), True, None, *x.shape, x.tobytes()) for i, x in enumerate(images)]
    df = spark.createDataFrame(rows, "file string, ok boolean, error string, height int, width int, channels int, data binary")
    got = {r["file"]: r for r in J.content_box(J.activity(df)).collect()}
    for i, x in enumerate(images):
        h, w = x.shape[:2]
        g = np.rint(PX.gray(x))
        lap = np.zeros((h, w))
        for y in range(h):
            for z in range(w):
                at = lambda a, b: g[-a if a < 0 else 2 * h - 2 - a if a >= h else a, -b if b < 0 else 2 * w - 2 - b if b >= w else b]
                lap[y, z] = abs(2 * sum(at(y + p, z + q) for p in (-1, 1) for q in (-1, 1)) - 8 * g[y, z])
        box = []
        for axis, side in ((1, h), (0, w)):
            k = max(side // 20, 4)
            strips = [lap[s * k : s * k + k].mean() if axis else lap[:, s * k : s * k + k].mean() for s in range(side // k)]
            loud = [s for s, a in enumerate(strips) if a > max(lap.mean() / 4, 1)] or [0, side // k - 1]
            box += [loud[0] * k, min(loud[-1] * k + k, side)]
        share = (box[1] - box[0]) * (box[3] - box[2]) / (h * w)
        trimmed = min(h, w) >= 64 and 0.25 <= share <= 0.9 and min(box[1] - box[0], box[3] - box[2]) >= 32
        want = box if trimmed else [0, h, 0, w]
        r = got[str(i)]
        assert [r["top"], r["bottom"], r["left"], r["right"]] == want and r["trimmed"] == trimmed
        assert (PX.content(x) == x[want[0] : want[1], want[2] : want[3]]).all()


def test_many_rows_of_one_name_and_chains_of_generated_names(spark):
    rows = [("a.png", i) for i in range(40)] + [(f"a_{k}.png", 100 + k) for k in (1, 2, 3, 5, 39)] + [("a_1_1.png", 200), ("a_1.png", 201), (None, 202)]
    got = N.resolve_collisions(spark.createDataFrame(rows, "name string, pos long")).collect()
    names = [r["unique_name"] for r in got if r["unique_name"]]
    assert len(names) == len(set(names)) == len(rows) - 1
    assert {(r["name"], r["pos"]) for r in got} == set(rows)
    first = {}
    for n, p in rows:
        first[n] = min(p, first.get(n, p))
    assert all(r["unique_name"] == r["name"] for r in got if first[r["name"]] == r["pos"])


def test_score_text_and_class_gate(spark):
    rows = [(["a", "b", "c"], [0.5, 0.4, 0.1], "good", 5.0), (["a", "b", "c"], [0.9, 0.08, 0.02], "good", 5.0), (["a", "b", "c"], [0.9, 0.08, 0.02], "low", 5.0), (["b", "a"], [0.6, 0.4], "best", 8.0)]
    df = spark.createDataFrame(rows, "labels array<string>, probs array<double>, aesthetic_label string, score double")
    gated = M.score_gate(M.class_gate(df, ["b"], 0.05), 6.0, True).withColumns({"ok": F.lit(True), "error": F.lit(None).cast("string")})
    got = [r["t"] for r in gated.select(M.format_score_text().alias("t")).collect()]
    assert got == [
        "score:5.00, quality:good, class:b, class_conf:40%, low_score:yes, fallback:margin, raw_class:a",
        "score:5.00, quality:good, class:b, class_conf:8%, low_score:yes, fallback:aesthetic, raw_class:a",
        "score:-, quality:-, class:a, class_conf:90%, class_passed:no",
        "score:8.00, quality:best, class:b, class_conf:60%",
    ]


def test_sharp_kernels_by_their_sums():
    rng = np.random.default_rng(5)
    image = rng.integers(0, 256, (11, 17, 3)).astype(np.uint8)
    curves = {
        "lanczos": (3, lambda x: 1.0 if x == 0 else 0.0 if abs(x) >= 3 else math.sin(math.pi * x) * math.sin(math.pi * x / 3) * 3 / (math.pi * x) ** 2),
        "bicubic": (2, lambda x: 1.5 * abs(x) ** 3 - 2.5 * x * x + 1 if abs(x) <= 1 else -0.5 * (abs(x) ** 3 - 5 * x * x + 8 * abs(x) - 4) if abs(x) < 2 else 0.0),
    }

    def line(values, m, curve):
        n, out = len(values), []
        for o in range(m):
            w = [curve((i + 0.5 - (o + 0.5) * n / m) / max(n / m, 1)) for i in range(n)]
            out.append(min(255, max(0, round(sum(a * b for a, b in zip(w, values)) / sum(w)))))
        return out

    for kernel, (_, curve) in curves.items():
        for width, height in ((6, 5), (23, 19), (17, 4)):
            got = PX.resize_sharp(image, width, height, kernel)
            for c in range(3):
                across = [line(r, width, curve) for r in image[..., c].tolist()]
                want = [line(col, height, curve) for col in zip(*across)]
                assert got[..., c].T.tolist() == want
    flat = np.full((9, 9, 3), 77, np.uint8)
    assert (PX.resize_sharp(flat, 4, 20) == 77).all() and (PX.resize_sharp(image, 17, 11) == image).all()


def test_perspective_draws_into_a_quadrangle():
    flat = np.full((40, 60, 3), 200, np.uint8)
    got = PX.perspective(flat, 0.25, 9)
    assert set(np.unique(got)) == {0, 200}  # the image keeps its colour, and there is nothing around it
    assert (got[12:28, 18:42] == 200).all()  # whatever lies further inside than a corner can be
    assert (PX.perspective(flat, 0, 9) == flat).all() and (PX.perspective(flat, 0.25, 9) == got).all()
    ramp = np.repeat(np.arange(60, dtype=np.uint8)[None, :, None] * 4, 40, 0)
    inner = PX.perspective(ramp, 0.2, 3)[10:30, 15:45, 0].astype(int)
    assert (np.diff(inner, axis=1) > 0).all()


def test_density_neighbours_recall(spark):
    """At least nine in ten of the pairs within the radius are found by the random projections."""
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").toPandas()
    x = np.stack(rows["embedding"]).astype(float)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True))[:, :10]
    dist = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(dist <= 0.5, 1)))}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, feature array<double>")
    got = {(r["a"], r["b"]) for r in K.near_pairs(df, 0.5).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) > 900
