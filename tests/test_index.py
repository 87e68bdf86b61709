"""The hash index, candidates by parts, free numbers and sidecar files against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from easel.functions import names as N
from easel.operators import duplicates as D
from easel.operators import hamming as H
from easel.sources import images as S
from easel.sources.sidecars import SidecarWriter


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def _rows(rng, n, words, far):
    """Hashes with neighbours at all distances up to far, and copies."""
    out = []
    while len(out) < n:
        h = rng.getrandbits(64 * words)
        out.append(h)
        for _ in range(rng.randint(0, 3)):
            e = 0
            for b in rng.sample(range(64 * words), rng.randint(0, far)):
                e |= 1 << b
            out.append(h ^ e)
    return [(i, [_signed(h >> 64 * w & (1 << 64) - 1) for w in range(words)]) for i, h in enumerate(out[:n])]


def _pairs(rows, threshold):
    out = set()
    for i, a in rows:
        for j, b in rows:
            d = sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a, b))
            if i < j and d <= threshold:
                out.add((i, j, d))
    return out


@pytest.mark.parametrize("words, threshold, rows", [(4, 40, None), (4, 40, 100_000), (4, 40, 2_000_000), (1, 20, None), (1, 3, 10**7), (1, 3, 1000), (1, 6, 10**8), (2, 0, 500)])
def test_hamming_pairs_of_every_layout(spark, words, threshold, rows):
    given = _rows(random.Random(words * threshold), 220, words, threshold + 4)
    df = spark.createDataFrame([(i, h, f"k{i}") for i, h in given] + [(None, given[0][1], "n"), (900, None, "n")], "id long, hash array<bigint>, k string")
    got = D.hamming_pairs(df, threshold, words=words, keep=("k",), rows=rows).collect()
    want = _pairs(given, threshold)
    assert len(got) == len(want) and {(r["a"], r["b"], r["dist"]) for r in got} == want and len(want) > 40
    assert all(r["a_k"] == f"k{r['a']}" and r["b_k"] == f"k{r['b']}" and abs(r["sim"] - (1 - r["dist"] / (64 * words))) < 1e-12 for r in got)


def test_layouts_cover_all_errors():
    """The shares and one for each part make up for one error more than there are; words meet where a part keeps its share."""
    for total, t in ((256, 40), (64, 3), (64, 6), (128, 12)):
        seen = list(H.layouts(total, t))
        assert seen and any(p.code for parts in seen for p in parts)
        for parts in seen:
            assert parts[0].start == 0 and parts[-1].start + parts[-1].width == total
            assert sum(p.left + p.right - 2 * (p.code > 0) + 1 for p in parts) >= t + 1
    rng = random.Random(1)
    for p in (H.Part(0, 19, 1, 1, 0), H.Part(0, 17, 2, 2, 4), H.Part(0, 15, 2, 3, 4), H.Part(0, 20, 2, 3, 4)):
        left, right = p.patterns(p.left), p.patterns(p.right)
        code = 1 if p.code else 0
        for _ in range(60):
            x, e = rng.getrandbits(p.width), p.left + p.right - 2 * code
            y = x ^ sum(1 << b for b in rng.sample(range(p.width), e))
            lists = [{int(v) ^ int(m) for m in table[int(p.syndromes(H.np.array([v], H.np.uint64))[0])]} for v, table in ((x, left), (y, right))]
            assert lists[0] & lists[1]
            assert not p.code or all(p.syndromes(H.np.array([w], H.np.uint64))[0] == 0 for w in lists[0])


def test_keys_widen_and_comparisons_a_row_grow_slower_than_rows():
    meets = lambda parts, n: n * sum(p.keys(p.left) * p.keys(p.right) / 2.0 ** (p.width - p.code) for p in parts)
    few, many = H.best_layout(256, 40, 10**5), H.best_layout(256, 40, 10**7)
    assert many[0].width > few[0].width and meets(many, 10**7) < 10 * meets(few, 10**5)
    assert H.best_layout(64, 20, 10**6) is None


def test_comparisons_measured(spark):
    """Rows that a join by keys meets by chance, counted at two sizes, are about what the layout's cost says."""
    rng = random.Random(5)
    for n in (400, 1600):
        layout = H.best_layout(256, 40, 100_000)
        rows = spark.createDataFrame([(i, [_signed(rng.getrandbits(64)) for _ in range(4)]) for i in range(n)], "c long, h array<bigint>")
        want = n * n * sum(p.keys(p.left) * p.keys(p.right) / 2.0 ** (p.width - p.code) for p in layout)
        import pyarrow as pa

        keys = {}
        t = rows.toArrow().combine_chunks()
        h = H._longs(t["h"].combine_chunks() if isinstance(t["h"], pa.ChunkedArray) else t["h"], 4)
        met = 0
        for k, p in enumerate(layout):
            v = p.values(h, 64)
            keys = {}
            for x in v.tolist():
                for m in p.patterns(p.left)[0].tolist():
                    keys[x ^ m] = keys.get(x ^ m, 0) + 1
            met += sum(keys.get(x ^ m, 0) for x in v.tolist() for m in p.patterns(p.right)[0].tolist())
        own = n * sum(min(len(p.patterns(p.left)[0]), len(p.patterns(p.right)[0])) for p in layout)  # each row with itself
        assert abs(met - own - want) < 0.15 * want


def test_descriptor_candidates(spark):
    rng = random.Random(3)
    base = {i: [rng.getrandbits(64) for _ in range(12)] for i in range(14)}
    common = [rng.getrandbits(64) for _ in range(3)]  # in every image
    desc = [(i, k, [_signed(d)]) for i, ds in base.items() for k, d in enumerate(ds + common)]
    for i in range(4):  # near copies: some descriptors are another's but for a few bits
        desc += [(20 + i, k, [_signed(d ^ (1 << rng.randrange(64)))]) for k, d in enumerate(base[i][:6])]
    df = spark.createDataFrame(desc + [(None, 0, [1]), (50, 0, None)], "id long, kp int, d array<bigint>")
    linked = spark.createDataFrame([(0, 20)], "a long, b long")
    sets = {}
    for i, _, (d,) in desc:
        sets.setdefault(i, set()).update((n, (d >> (n * 8)) & 255) for n in range(8))
    for least in (1, 4, 9):
        want = {(a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= least} - {(0, 20, len(sets[0] & sets[20]))}
        got = D.descriptor_candidates(df, linked, words=1, parts=8, least=least).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_recall_of_matches(spark):
    """Pairs with 4 good matches among all pairs are proposed."""
    rng = random.Random(9)
    base = {i: [[rng.getrandbits(64) for _ in range(4)] for _ in range(20)] for i in range(12)}
    near = lambda d: [w ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for w in d]
    desc = [(i, k, d) for i, ds in base.items() for k, d in enumerate(ds)] + [(100 + i, k, near(d)) for i in range(8) for k, d in enumerate(base[i][: 5 + i])]
    df = spark.createDataFrame([(i, k, [_signed(w) for w in d]) for i, k, d in desc], "id long, kp int, d array<bigint>")
    ids = df.select("id").distinct()
    everything = ids.select(F.col("id").alias("a")).crossJoin(ids.select(F.col("id").alias("b"))).where("a < b")
    want = {(r["a"], r["b"]) for r in D.descriptor_matches(everything, df).collect()}
    proposed = {(r["a"], r["b"]) for r in D.descriptor_candidates(df).collect()}
    assert len(want) >= 8 and len(want & proposed) >= 0.9 * len(want) and len(proposed) < 40
    assert {(r["a"], r["b"]) for r in D.descriptor_matches(D.descriptor_candidates(df), df).collect()} == want & proposed


def _free(rows, existing, first):
    """Names one after another: all given names and taken ones are out of use for numbers."""
    given, out, seen = {n for n, _ in rows if n} | existing, {}, set(existing)
    for n, p in sorted((r for r in rows if r[0]), key=lambda r: (r[0], r[1])):
        if n not in seen:
            seen.add(n)
            out[n, p] = n
            continue
        dot = n.rfind(".")
        stem, ext = (n[:dot], n[dot:]) if dot > 0 else (n, "")
        k = first
        while f"{stem}_{k}{ext}" in given or f"{stem}_{k}{ext}" in seen:
            k += 1
        seen.add(f"{stem}_{k}{ext}")
        out[n, p] = f"{stem}_{k}{ext}"
    return out


@pytest.mark.parametrize("first", [1, 2])
def test_free_numbers(spark, first):
    rng = random.Random(first)
    stems = ["a", "a_1", "b.x", "c", "_", "a_1_2", "d_01", ".hid"]
    rows = [(rng.choice(stems) + rng.choice(["", "_1", "_2", "_3", "_5", "_12"]) + rng.choice([".png", ".jpg", ""]), i) for i in range(260)] + [(None, 900), (None, 901)]
    taken = {f"a_{k}.png" for k in (2, 3, 4, 7, 8, 30)} | {"a.png", "c.jpg", "c_1.jpg", "unused_4.png", "d_01.png", "a_99999999999999999999.png"}
    for existing in (set(), taken):
        old = spark.createDataFrame([(t,) for t in existing] * 2 + [(None,)], "name string") if existing else None
        got = {(r["name"], r["pos"]): r["unique_name"] for r in N.resolve_collisions(spark.createDataFrame(rows, "name string, pos long"), existing=old, first=first).collect()}
        assert got == _free(rows, existing, first) | {(None, 900): None, (None, 901): None}


def test_ten_thousand_taken_numbers(spark):
    """About as many jobs as with none: adaptive execution adds a few, taken names none."""
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    df = spark.createDataFrame([("photo.png", i) for i in range(30)], "name string, pos long")
    jobs = []
    for n, group in ((0, "none"), (10_000, "many")):
        old = spark.createDataFrame([("photo.png",)] + [(f"photo_{k}.png",) for k in range(2, n + 2)], "name string")
        sc.setJobGroup(group, group)
        got = sorted(r["unique_name"] for r in N.resolve_collisions(df, existing=old, first=2).collect())
        jobs.append(len(tracker.getJobIdsForGroup(group)))
        assert got == sorted(f"photo_{k}.png" for k in range(n + 2, n + 32))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= jobs[0] + 10


def test_sidecars_of_equal_stems_in_two_folders(spark, tmp_path):
    at = f"file://{tmp_path}"
    rows = [(f"{at}/a/1.png", " one \n"), (f"{at}/b/1.png", "two"), (f"{at}/a/odd name+x.png", "three é"), (f"{at}/b/2.png", ""), (None, "lost")]
    df = spark.createDataFrame(rows, "file string, text string")
    assert tuple(S.write_sidecar_files(df).first()) == (4, 1)
    assert (tmp_path / "a/1.txt").read_text() == " one \n" and (tmp_path / "b/1.txt").read_text() == "two"
    images = df.where("file is not null").select("file").union(spark.createDataFrame([(f"{at}/b/none.png",)], "file string"))
    got = {r["file"].removeprefix(at): r["text"] for r in S.read_sidecars(spark, images, str(tmp_path)).collect()}
    assert got == {"/a/1.png": "one", "/b/1.png": "two", "/a/odd name+x.png": "three é", "/b/2.png": "", "/b/none.png": ""}
    # replaced, and read from one folder by stem
    S.write_sidecar_files(df.limit(1).withColumn("text", F.lit("new")), f"{at}/all")
    assert {r["text"] for r in S.read_sidecars(spark, images.where("file like '%/1.png'"), str(tmp_path), folder=f"{at}/all").collect()} == {"new"}
    assert not [p for p in tmp_path.rglob("*") if p.is_file() and p.suffix != ".txt"]


def test_a_failed_task_leaves_no_sidecars(spark, tmp_path):
    (tmp_path / "1.txt").write_text("old")
    (tmp_path / "blocked").write_text("a file where a folder is wanted")
    rows = [(f"file://{tmp_path}/{k}.png", "new") for k in range(1, 30)] + [(f"file://{tmp_path}/blocked/x.png", "new")]
    with pytest.raises(Exception):
        S.write_sidecar_files(spark.createDataFrame(rows, "file string, text string").repartition(4))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["1.txt", "blocked"] and (tmp_path / "1.txt").read_text() == "old"


def test_an_aborted_job_removes_what_its_tasks_wrote(tmp_path):
    w = SidecarWriter()
    done = w.write(iter([(f"{tmp_path}/x/1.txt", "a"), (f"{tmp_path}/x/2.txt", None)]))
    assert len(list((tmp_path / "x").iterdir())) == 2
    w.abort([done, None])
    assert list((tmp_path / "x").iterdir()) == []


def test_joins_of_pairs_do_not_pass_through_the_driver(spark):
    """However small the tables are, no side of the joins of classes, members, links and reports is broadcast."""
    v = spark.range(60).select("id", F.array((F.col("id") * 37 % 11).cast("long")).alias("hash"))
    e = D.hamming_pairs(v, 1)
    report = D.dedup_report(v.select("id"), D.star_groups(e), e)[0]
    wide = D.hamming_pairs(spark.range(60).select("id", F.array(*[F.col("id") * 37 % 11] * 4).alias("hash")), 2, words=4, rows=10**7)
    for df, n in ((e, 60), (report, 60), (wide, 60)):
        assert df.count() >= n
        assert "Broadcast" not in df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
