"""SimHash near-duplicates through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each read as a 23-bit word. Of 4 errors the
two best segments have at most 2 each. The (23, 12) Golay code is perfect: each word has one codeword within
3, and words within 2 of each other share a codeword within 4. So every pair of segments gives a key for each
pair of codeword indices within 4 of its words, and fingerprints within 4 bits share a key. Keys meet by
shuffle; within a key links are verified and a spanning forest of them is kept, which holds the same
components as all links without writing all pairs.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import components, fresh, map_batches, map_runs, stage, text_bytes

SEED = 42
MAX_BITS = 4
_GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
_SEGMENTS = ((0, 22), (22, 21), (43, 21))


def fingerprint(text: bytes, shingle: int = 4, seed: int = SEED, piece: int = 1 << 16) -> int:
    """Bit i is 1 if it is 1 in over half of the shingles' hashes; no words give 0."""
    words = text.lower().split()  # bytes: A-Z and the six ASCII white-space bytes alone
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    starts, ends, hashed = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for i in range(0, len(starts), piece):
        h = np.array([hashed(joined[s:e], seed) for s, e in zip(starts[i : i + piece], ends[i : i + piece])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tie, fp), fp the fingerprint as a signed long, tie a hash of the text as it is."""

    def run(cols: dict) -> dict:
        fps = np.array([fingerprint(t.as_py()) for t in cols["text"]], np.uint64)
        return {"doc_id": cols["doc_id"], "tie": cols["tie"], "fp": pa.array(fps.view(np.int64))}

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("tie"), text_bytes(text).alias("text"))
    return map_batches(rows, run, "doc_id long, tie long, fp long", "text")


def _syndrome(words: np.ndarray) -> np.ndarray:
    """The remainder of 23-bit polynomials by the generator."""
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (_GENERATOR << (bit - 11)), rest)
    return rest


@lru_cache(1)
def golay_errors() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: up to 6 error patterns of weight 4 or less, and how many there are."""
    patterns = np.array([sum(1 << i for i in c) for k in range(5) for c in combinations(range(23), k)])
    table, n = np.zeros((2048, 6), np.int64), np.zeros(2048, np.int64)
    for p, s in zip(patterns.tolist(), _syndrome(patterns).tolist()):
        table[s, n[s]] = p
        n[s] += 1
    return table, n


def near_codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (the upper 12 bits) of all codewords within 4 of each word: (n x 6, how many of the 6 count)."""
    table, n = golay_errors()
    s = _syndrome(words)
    return (words[:, None] ^ table[s]) >> 11, n[s]


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for each key of each unsigned 64-bit fingerprint."""
    near = [near_codewords((fps >> np.uint64(at)).astype(np.int64) & ((1 << size) - 1)) for at, size in _SEGMENTS]
    rows, keys = [], []
    for pair, (a, b) in enumerate(combinations(range(3), 2)):
        (xa, na), (xb, nb) = near[a], near[b]
        real = (np.arange(6) < na[:, None])[:, :, None] & (np.arange(6) < nb[:, None])[:, None, :]
        rows.append(np.nonzero(real)[0])
        keys.append((xa[:, :, None] << 12 | xb[:, None, :] | pair << 24)[real])
    return np.concatenate(rows), np.concatenate(keys)


def forest(rest: np.ndarray, most: int = MAX_BITS) -> list[tuple[int, int]]:
    """Links that connect what all links of up to `most` bits among these connect.

    Each member found takes all members not yet found that are near it, so a dense group costs a few passes.
    """
    links = []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= most
            if near.any():
                links += [(x, y) for y in rest[near]]
                queue += list(rest[near])
                rest = rest[~near]
    return links


def links_of_runs(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links within each run of equal keys; short runs are compared by shifting the whole batch."""
    cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.append(cut, len(keys)))
    short, found_a, found_b = np.repeat(size <= 16, size), [], []
    ks, fs = keys[short], fps[short]
    for d in range(1, int(size[size <= 16].max(initial=1))):
        hit = (ks[d:] == ks[:-d]) & (np.bitwise_count(fs[d:] ^ fs[:-d]) <= MAX_BITS)
        found_a.append(fs[:-d][hit])
        found_b.append(fs[d:][hit])
    for at, n in zip(cut[size > 16], size[size > 16]):
        links = forest(fps[at : at + n])
        found_a.append(np.array([a for a, _ in links], np.uint64))
        found_b.append(np.array([b for _, b in links], np.uint64))
    if not found_a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    pair = np.unique(np.stack([np.concatenate(found_a), np.concatenate(found_b)]), axis=1)
    return pair[0], pair[1]


def fingerprint_links(classes: DataFrame) -> DataFrame:
    """(fa, fb): enough links between distinct fingerprints (column fp) to give their components."""

    def with_keys(cols: dict) -> dict:
        fps = cols["fp"].to_numpy(zero_copy_only=False)
        rows, keys = golay_keys(fps.view(np.uint64))
        return {"key": pa.array(keys), "fp": pa.array(fps[rows])}

    keyed = map_batches(classes.select("fp", F.lit(b"12345678").alias("w")), with_keys, "key long, fp long", "w", 8 * 4096)

    def within(cols: dict) -> dict:
        a, b = links_of_runs(cols["key"], cols["fp"].view(np.uint64))
        return {"fa": a.view(np.int64), "fb": b.view(np.int64)}

    return map_runs(keyed, ["key"], [], within, "fa long, fb long").distinct()


def _named(fps: DataFrame) -> DataFrame:
    """(fp, root_fp, component_id) of the distinct fingerprints of (doc_id, fp): root_fp is the fingerprint that holds the
    smallest id of the component, the smallest of these."""
    classes = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "fingerprint-classes")
    # nodes in order of their smallest id, so that the smallest node of a component has its id
    node = F.struct(F.col("low").isNull().alias("none"), "low", "fp")
    ends = fingerprint_links(classes)
    for side in ("fa", "fb"):
        ends = ends.join(classes.select(F.col("fp").alias("_f"), node.alias(f"node_{side}")), F.col(side) == F.col("_f")).drop("_f")
    found = components(ends, "node_fa", "node_fb").select(F.col("node.fp").alias("_node"), "root")
    joined = classes.join(found, F.col("fp") == F.col("_node"), "left").withColumn("root", F.coalesce("root", node))
    return joined.select("fp", F.col("root.fp").alias("root_fp"), F.col("root.low").alias("component_id"))


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row.

    Null, empty and wordless texts have fingerprint 0 and link like any other. Equal fingerprints are one class;
    a null id keeps its row, and never names a component unless all ids of it are null. Long texts are hashed whole, in
    pieces. An empty table gives an empty result. Other columns of docs aren't read.
    """
    fps = stage(fingerprints(docs, doc_id, text).drop("tie"), "fingerprints")
    named = _named(fps).select(F.col("fp").alias("_fp"), "component_id")
    return fps.join(named, fps["fp"] == named["_fp"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of simhash_groups(), all columns kept, of any names: that of the smallest id, null
    last; of several with that id that of the smallest fingerprint, then of the smallest text hash; of rows equal in id
    and text, one. Very long texts are read whole. An empty table stays empty."""
    fps = stage(fingerprints(docs, doc_id, text), "fingerprints")
    roots = _named(fps.select("doc_id", "fp")).where("fp = root_fp").select(F.col("fp").alias("_fp"), F.col("component_id").alias("_low"))
    first = fps.join(roots, (F.col("fp") == F.col("_fp")) & F.col("doc_id").eqNullSafe(F.col("_low"))).groupBy("fp").agg(F.min(F.struct("tie", _no_null("doc_id").alias("id"))).alias("_k"))
    tie, key = fresh("tie"), fresh("id")
    first = first.select(F.col("_k.tie").alias(tie), F.col("_k.id").alias(key)).distinct()
    keyed = docs.withColumns({tie: F.xxhash64(F.col(text)), key: _no_null(doc_id)})
    return keyed.join(first, [tie, key]).dropDuplicates([tie, key]).select(*[F.col(f"`{c}`") for c in docs.columns])


def _no_null(doc_id: str) -> Column:
    """The id, null as the least long there is."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63)))
