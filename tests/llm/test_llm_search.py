"""Nearest neighbours, prefix trie and source divergence on small tables against plain Python."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from easel.llm import divergence, neighbours, prefix_trie
from easel.llm import queries as Q

CLASHING = "class_id long, q long, dim int, tree int, leaf int, low long, bound double, rank int, score string, query_id string, vec_id long, embedding array<float>, label int"


def _nearest(rows, every=100, k=10):
    """All pairs in doubles: rows (vec_id, vector) -> rows (query_id, rank, vec_id, score), sorted."""
    fine = [(i, np.array(v, np.float64)) for i, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = []
    for a, (i, x) in enumerate(fine):
        if i is not None and i % every == 0:
            far = sorted((math.sqrt(((x - y) ** 2).sum()), j is None, j or 0, j) for b, (j, y) in enumerate(fine) if a != b and len(y) == len(x))
            out += [(i, n + 1, f[3], f[0]) for n, f in enumerate(far[:k])]
    return sorted(out, key=str)


def _vectors(spark, rows):
    return spark.createDataFrame([(1, 2, 3, 4, 5, 6, 7.0, 8, "s", "q", i, v, 0) for i, v in rows], CLASHING)


def _got(df):
    return sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect()), key=str)


def _close(got, want):
    return [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12, atol=0)


def test_nearest_of_few_is_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(rng.normal(size=(330, 8)))]
    same = rows[100][1]
    rows += [(1000 + i, same) for i in range(40)] + [(200, same), (None, same), (None, rows[7][1]), (300, rows[300][1]), (7, rows[0][1])]
    rows += [(400, None), (500, []), (600, [0.0] * 8), (700, [math.nan] * 8), (800, [math.inf] * 8), (900, [None] * 8), (1100, [1.0, 2.0]), (1101, [1.0, 3.0]), (1200, [3.0])]
    got = _got(neighbours.nearest(_vectors(spark, rows)))
    assert _close(got, _nearest(rows)) and {g[0] for g in got} == {0, 100, 200, 300, 1000, 1100}
    assert neighbours.nearest(_vectors(spark, rows).limit(0)).collect() == []
    assert neighbours.nearest(_vectors(spark, rows[:1])).collect() == []  # a lone query has no candidates
    # doubles stay doubles
    wide = [(i, [1.0, 1.0 + i * 1e-12]) for i in range(5)] + [(100, [1e-200, 2e-200])]
    df = spark.createDataFrame(wide, "vec_id long, embedding array<double>")
    assert _close(_got(neighbours.nearest(df)), _nearest(wide))


def test_forest_recall_and_exact_scores(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 24))
    v = np.concatenate([centres[rng.integers(0, 20, 3000)] + 0.3 * rng.normal(size=(3000, 24)), rng.normal(size=(1500, 24))])
    rows = [(i, [float(np.float32(c)) for c in x]) for i, x in enumerate(v)]
    got, want = _got(neighbours.nearest(_vectors(spark, rows), leaf=64, first=256)), _nearest(rows)
    assert len(got) == len(want)
    assert len({g[::2] for g in got} & {w[::2] for w in want}) >= 0.9 * len(want)
    for i, _, j, score in got:
        assert math.isclose(score, math.sqrt(((np.array(rows[i][1]) - np.array(rows[j][1])) ** 2).sum()), rel_tol=1e-12)
    by = collections.defaultdict(list)
    for g in sorted(got, key=lambda g: g[:2]):
        by[g[0]].append(g)
    assert all([g[1] for g in x] == list(range(1, 11)) and [g[3] for g in x] == sorted(g[3] for g in x) for x in by.values())


def test_queue_gives_leaves_in_order():
    rng = np.random.default_rng(7)
    f = neighbours.Forest(6, 3, 4, 1)
    x = rng.normal(size=(500, 6))
    f.fit(f.project(x))
    leaves = f.leaves(x)
    assert all(20 <= n <= 45 for t in range(3) for n in np.bincount(leaves[:, t], minlength=16))
    for y in x[:20]:
        found = list(f.search(y))
        assert len({p[1:] for p in found}) == len(found) == 48 and [p[0] for p in found] == sorted(p[0] for p in found)
        own = f.leaves(y[None])[0]
        assert {p[1:] for p in found if p[0] == 0} >= set(enumerate(own.tolist()))
        # a priority is the largest gap to a plane that parts the query from the leaf
        for far, t, leaf in found:
            gaps, node = [0.0], 1
            for level in range(4):
                gap = f.project(y[None])[0, t, level] - f.thresholds[t, node]
                to = leaf >> (3 - level) & 1
                gaps += [abs(gap)] if (gap >= 0) != to else []
                node = 2 * node + to
            assert math.isclose(far, max(gaps))


def test_recall_on_given_vectors(spark):
    """Most of the given vectors have no near neighbours, the hardest case."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r[0], list(r[1])) for r in df.select("vec_id", "embedding").collect()]
    got, want = _got(Q.op11_nearest_vectors(spark, "/root/testdata/sf0.1")), _nearest(rows)
    assert len(got) == len(want) and len({g[::2] for g in got} & {w[::2] for w in want}) >= 0.9 * len(want)


def _trie(rows, every=100, heads=6):
    """rows (conv_id, turn, role, text) -> the nodes, sorted, by dictionaries of tuples."""
    own = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        seq = tuple(own.get(c - int(math.fmod(c, every)), [])[:h] + v[h:])
        ends[seq].append(c)
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids, leaves, saved = collections.Counter(), collections.Counter(), collections.Counter()
    for k in members:
        if k:
            kids[k[:-1]] += 1
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    return sorted(((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()) for k, m in members.items()), key=str)


@pytest.mark.parametrize("width", [4, 1 << 18])
def test_prefix_nodes(spark, width):
    rng = random.Random(2)
    rows = []
    for c in [*range(-120, 330, 3), 200, 300]:
        rows += [(c, t, rng.choice(["user", "bot", None]), rng.choice(["a", "b", "é漢", None, ""])) for t in range(rng.randint(1, 6))]
    rows += [(c, 0, "user", "hot") for c in range(1000, 1100)] + [(c, t, "user", "same") for c in range(2000, 2060) for t in range(3)]
    rows += [(5, None, "user", "first"), (5, None, "user", "first"), (7, 1, "b", "tie"), (7, 1, "a", "tie"), (None, 0, "user", "x"), (401, 0, "user", "lost"), (9, 99, "long", "y" * 100_000)]
    rows += [(700, t, "user", f"t{t}") for t in range(300)]
    df = spark.createDataFrame([(*r, 1, "k", "p", 2, "r") for r in rows], "conv_id long, turn long, role string, text string, depth int, key string, prefix string, n int, `range` string")
    got = sorted((tuple(r) for r in prefix_trie.prefix_nodes(df, turns_a_range=width).collect()), key=str)
    assert got == _trie(rows)
    assert prefix_trie.prefix_nodes(df.limit(0)).collect() == []


def test_a_turnless_conversation_is_a_member_of_the_root(spark):
    c = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 == 3)  # its own two turns go, none come
    df = spark.createDataFrame([(c, 0, "u", "a"), (c, 1, "u", "b")], "conv_id long, turn int, role string, text string")
    assert [tuple(r) for r in prefix_trie.prefix_nodes(df).collect()] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


@pytest.mark.parametrize("alphabet, width", [(2, 1), (256, 1), (3, 2), (40, 1)])
def test_radix_tree_layouts_and_ranges(alphabet, width):
    """Nodes of all layouts; cutting the keys into ranges and adding the shares up changes nothing."""
    rng = random.Random(alphabet)
    keys = sorted({bytes(rng.randrange(alphabet) for _ in range(width * rng.randint(0, 6))) for _ in range(900)})

    def of(cut):
        done, shares = [], {}
        for i, j in zip(cut, cut[1:]):
            trie = prefix_trie.RangeTrie(keys[i - 1] if i else None, keys[j] if j < len(keys) else None, width)
            for n, k in enumerate(rng.sample(keys[i:j], j - i)):
                trie.add(k, 1 + k.count(b"\x00"), len(k) * 7 % 11, [3 + d for d in range(len(k) // width)], k.hex())
            for row in trie.nodes():
                if row[8] is None:
                    done.append((row[1], *row[3:8]))
                else:
                    s = shares.setdefault(row[8], [row[1], 0, 0, 0, 0, None])
                    for c in range(4):
                        s[1 + c] += row[3 + c]
                    s[5] = row[7] if s[5] is None else s[5]
        return sorted(map(str, done + [tuple(s) for s in shares.values()])), trie

    whole, trie = of([0, len(keys)])
    assert len(whole) == len({k[: d * width] for k in keys for d in range(len(k) // width + 1)})
    for parts in (2, 7, 60):
        assert of([0, *sorted(rng.sample(range(1, len(keys)), parts - 1)), len(keys)])[0] == whole
    layouts, rest = set(), [trie.root]
    while rest:
        layouts.add((node := rest.pop()).layout())
        rest += node.children()
    assert layouts >= ({4, 256} if alphabet == 256 else {4, 48} if alphabet == 40 else {4})


def _audit(rows, least=3, top=200):
    terms = [(l or "", s or "", [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", x or "")]) for x, l, s in rows]
    out = []
    for lang in {t[0] for t in terms}:
        docs, groups, everything = collections.Counter(), collections.defaultdict(collections.Counter), collections.Counter()
        for l, s, t in terms:
            if l == lang:
                docs.update(set(t))
                groups[s].update(t)
        kept = [t for t, n in docs.items() if n >= least]
        for g in groups.values():
            everything.update(g)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[u] for u in kept) + len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in groups.items()}, share(everything)
        for s, c in groups.items():
            pair = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in groups if o != s]
            term = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if c[t] > 0 and p[s][t] > q[t]]
            for part, some in (("pair", pair), ("term", term)):
                some.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, v, n + 1) for n, (v, i) in enumerate(some) if part == "pair" or n < top]
    return sorted(out, key=str)


@pytest.mark.parametrize("groups, terms", [(64, 2048), (2, 16), (1, 5)])
def test_audit_sources(spark, groups, terms):
    rng = random.Random(8)
    words = ["Ab", "ab", "É", "é", "漢字", "x1y", "don't", "z\x00q", "_a_", "~~"] + [f"w{chr(97 + k)}{chr(97 + j)}" for k in range(9) for j in range(4)]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "ü", None])) for _ in range(120)]
    rows += rows[:5] + [(None, "en", "lone"), ("", "xx", "p"), ("only once", "xx", "q"), ("hot " * 50_000 + "ab", "en", "a"), ("12 34", "de", "digits")]
    rows += [("many", "yy", str(k)) for k in range(7)]
    df = spark.createDataFrame([(*r, 1, 2, "t", "i", 3, 4) for r in rows], "text string, lang string, source string, n long, g int, term string, item string, value long, `rank` int")
    got = sorted((tuple(r) for r in divergence.audit_sources(df, groups_a_block=groups, terms_a_block=terms, top=20).collect()), key=str)
    assert got == _audit(rows, top=20)
    assert divergence.audit_sources(df.limit(0)).collect() == []


def test_shares_are_exact_for_large_counts():
    n = np.array([0, 1, 10**12, 4 * 10**15])
    total, terms = 5 * 10**15, 12_345
    assert divergence.shares(n, total, terms).tolist() == [1 + 10**9 * (int(c) + 1) // (total + terms) for c in n]
