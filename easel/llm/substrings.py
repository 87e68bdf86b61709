"""Substring dedup with difference-cover anchors.

A difference cover D modulo v has, for any two places, one shift below v that takes both into D. So where two
documents share a window of `window` words, they share an anchor of window - v + 1 words that starts at a cover
place (modulo v) in both and lies inside the window. Only anchors at cover places are hashed and dealt out; those
found in two documents are extended to the windows around them, and these windows are compared whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh, map_batches, map_runs, stage, text_bytes

#: A perfect difference set: every difference modulo 31 occurs once.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BATCH = 8 << 20


def covers(cover=COVER, period: int = PERIOD) -> bool:
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash for each k consecutive word hashes, joined from hashes of 1, 2, 4, .. words."""
    n = max(0, len(h) - k + 1)
    if not n:
        return np.zeros(0, np.uint64)

    def join(a, b):
        a = (a ^ a >> np.uint64(29)) * _STEP
        return (a ^ a >> np.uint64(32)) + b * _MIX

    out, at, size, power = np.zeros(n, np.uint64), 0, 1, h
    while k:
        if k & 1:
            out = join(out, power[at : at + n])
            at += size
        k >>= 1
        if k:
            power = join(power[:-size], power[size:])
            size *= 2
    return (out ^ out >> np.uint64(31)) * _MIX


def merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges [a, b) as fewest ranges, in order."""
    if not len(a):
        return a, b
    o = np.argsort(a, kind="stable")
    a, b = a[o], np.maximum.accumulate(b[o])
    new = np.concatenate([[True], a[1:] > b[:-1]])
    return a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)]


def merged_by(docs: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(docs, a, b) of each document's ranges as fewest ranges: documents lie one behind the other, apart."""
    own, nth = np.unique(docs, return_inverse=True)
    far = int(b.max(initial=0)) + 1
    x, y = merged(a + nth * far, b + nth * far)
    nth = x // far
    return own[nth], x - nth * far, y - nth * far


def _several(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted order by (key, doc), and in it: each row's smallest doc of its key, and its largest."""
    o = np.lexsort((docs, keys))
    k, d = keys[o], docs[o]
    cut = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    size = np.diff(np.append(cut, len(k)))
    return o, np.repeat(d[cut], size), np.repeat(d[np.append(cut[1:], len(k)) - 1] if len(k) else d, size)


def _words(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("text"))


def sequences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, whole): the number of words and the SHA-256 of all words joined by one space."""

    def run(cols: dict) -> dict:
        words = [t.as_py().split() for t in cols["text"]]
        return {"doc_id": cols["doc_id"], "n_words": pa.array([len(w) for w in words], pa.int64()), "whole": pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in words])}

    return map_batches(_words(docs, doc_id, text), run, "doc_id long, n_words long, whole string", "text")


def shared_anchors(docs: DataFrame, window: int, cover=COVER, period: int = PERIOD) -> DataFrame:
    """(doc_id, a, b): ranges of window starts that have an anchor that another document has too.

    A batch of documents is combined first: an anchor that two of its documents hold is shared, and one of its
    places stands for all in the shuffle, so an anchor in most documents stays small there.
    """
    length = window - period + 1
    if not covers(cover, period) or length < 1:
        raise ValueError("the cover must hold all differences, and its period fit the window")
    at_cover = np.isin(np.arange(period), cover)

    def anchors(cols: dict) -> dict:
        hs, ds, ps, ns = [], [], [], []
        for d, t in zip(cols["doc_id"].to_numpy(zero_copy_only=False), cols["text"]):
            words = t.as_py().split()
            if len(words) >= window:
                h = window_hashes(word_hashes(words), length)
                p = np.flatnonzero(np.resize(at_cover, len(h)))
                hs.append(h[p]), ps.append(p), ds.append(np.full(len(p), d)), ns.append(np.full(len(p), len(words) - window))
        if not hs:
            return dict.fromkeys(("key", "doc_id", "a", "n", "known"), pa.array([], pa.int64()))
        h, d, p, n = (np.concatenate(x) for x in (hs, ds, ps, ns))
        a, b = np.maximum(0, p + length - window), np.minimum(p, n) + 1
        o, low, high = _several(h, d)
        h, d, a, b = h[o], d[o], a[o], b[o]
        known = low < high
        first = np.concatenate([[True], h[1:] != h[:-1]])
        out = [[h[~known | first], d[~known | first], a[~known | first], b[~known | first], np.zeros((~known | first).sum(), np.int64)]]
        dk, ak, bk = d[known], a[known], b[known]
        dk, x, y = merged_by(dk, ak, bk)
        out.append([dk.view(np.uint64) * _MIX, dk, x, y, np.ones(len(x), np.int64)])
        key, doc, a, b, known = (np.concatenate(x) for x in zip(*out))
        # lengths are nearly all the same, so they take less room in the shuffle than ends
        return {"key": pa.array(key.view(np.int64)), "doc_id": pa.array(doc), "a": pa.array(a), "n": pa.array(b - a), "known": pa.array(known)}

    def shared(cols: dict) -> dict:
        known = cols["known"] == 1
        cols["b"] = cols["a"] + cols["n"]
        k, d, a, b = (cols[c][~known] for c in ("key", "doc_id", "a", "b"))
        o, low, high = _several(k, d)
        hit = o[low < high]
        return {"doc_id": np.concatenate([d[hit], cols["doc_id"][known]]), "a": np.concatenate([a[hit], cols["a"][known]]), "b": np.concatenate([b[hit], cols["b"][known]])}

    rows = map_batches(docs, anchors, "key long, doc_id long, a long, n long, known long", "text", _BATCH)
    return map_runs(rows, ["key"], [], shared, "doc_id long, a long, b long")


def repeated_windows(candidates: DataFrame, window: int) -> DataFrame:
    """(doc_id, row, a, b): ranges of words covered by windows that a smaller document has too.

    candidates: (doc_id, row, text, starts), starts the ranges of window starts to compare. A batch is combined
    first: whoever isn't the smallest holder of a window in its batch is found at once, and only the smallest
    goes to the shuffle.
    """

    def windows(cols: dict) -> dict:
        hs, gs, ds, rs, ps = [], [], [], [], []
        for d, r, t, s in zip(cols["doc_id"].to_numpy(), cols["row"].to_numpy(), cols["text"], cols["starts"]):
            h = word_hashes(t.as_py().split())
            full = window_hashes(h, window)
            want = np.zeros(len(full) + 1, np.int64)
            for x in s.as_py():
                if x["a"] < len(full):
                    want[x["a"]] += 1
                    want[min(x["b"], len(full))] -= 1
            p = np.flatnonzero(np.cumsum(want)[:-1] > 0)
            hs.append(full[p]), gs.append(window_hashes(h[::-1], window)[::-1][p]), ds.append(np.full(len(p), d)), rs.append(np.full(len(p), r)), ps.append(p)
        h, g, d, r, p = (np.concatenate(x) for x in (hs, gs, ds, rs, ps))
        g = g.view(np.int64) >> 32
        o = np.lexsort((d, g, h))
        h, g, d, r, p = h[o], g[o], d[o], r[o], p[o]
        cut = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])) if len(h) else np.zeros(0, np.int64)
        known = d > np.repeat(d[cut], np.diff(np.append(cut, len(h))))
        kd, kr, kp = d[known], r[known], p[known]
        out = [[h[~known].view(np.int64), g[~known], d[~known], r[~known], p[~known], np.full((~known).sum(), window), np.zeros((~known).sum(), np.int64)]]
        o = np.lexsort((kp, kr, kd))
        kd, kr, kp = kd[o], kr[o], kp[o]
        edge = np.concatenate([[True], (kd[1:] != kd[:-1]) | (kr[1:] != kr[:-1]) | (kp[1:] > kp[:-1] + window)]) if len(kd) else np.zeros(0, bool)
        i = np.flatnonzero(edge)
        j = np.append(i[1:], len(kd)) - 1 if len(i) else i
        out.append([(kd[i].view(np.uint64) * _MIX).view(np.int64), np.zeros(len(i), np.int64), kd[i], kr[i], kp[i], kp[j] + window - kp[i], np.ones(len(i), np.int64)])
        return dict(zip(("key", "more", "doc_id", "row", "a", "n", "known"), (pa.array(np.concatenate(x)) for x in zip(*out))))

    def later(cols: dict) -> dict:
        known = cols["known"] == 1
        cols["b"] = cols["a"] + cols["n"]
        k, g, d, r, a, b = (cols[c][~known] for c in ("key", "more", "doc_id", "row", "a", "b"))
        o = np.lexsort((d, g, k))
        k, g, d, r, a, b = k[o], g[o], d[o], r[o], a[o], b[o]
        cut = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (g[1:] != g[:-1])])) if len(k) else np.zeros(0, np.int64)
        hit = d > np.repeat(d[cut], np.diff(np.append(cut, len(k))))
        return {c: np.concatenate([x[hit], cols[c][known]]) for c, x in (("doc_id", d), ("row", r), ("a", a), ("b", b))}

    rows = map_batches(candidates, windows, "key long, more long, doc_id long, row long, a long, n long, known long", "text", _BATCH)
    return map_runs(rows, ["key"], [], later, "doc_id long, row long, a long, b long")


def _row_hash(joined: bytes) -> int:
    return int.from_bytes(hashlib.sha256(joined).digest()[:8], "big", signed=True)


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 50) -> DataFrame:
    """(doc_id, whole, n_words, n_removed, removed, kept_sha256) for each row.

    A word goes if a window of `window` words of one document covers it whose words also start in a document with
    a smaller id. removed holds the ranges [a, b) of words that go; it is null for a copy that goes whole. whole
    is the SHA-256 of all words joined by one space, kept_sha256 that of the kept words. Null, empty and short
    texts lose nothing. Rows of one id don't take words from each other; rows with a null id neither lose words
    nor take any. Very long texts are read whole, one at a time. An empty table gives an empty result. Other columns of
    docs aren't read.
    """
    rows = stage(sequences(docs, doc_id, text), "sequences")
    first = rows.groupBy("whole").agg(F.min("doc_id").alias("first"))
    rows_at = rows.join(first, "whole").withColumn("copy", F.coalesce((F.col("doc_id") > F.col("first")) & (F.col("n_words") >= window), F.lit(False)))
    rows = stage(rows_at.select("doc_id", "n_words", "whole", "copy"), "sequences")
    given = _words(docs, doc_id, text).where("doc_id is not null")
    starts = shared_anchors(given, window).groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("starts"))
    # an id whose every row is a copy has nothing left to find
    own = rows.groupBy(F.col("doc_id").alias("_id")).agg(F.bool_or(~F.col("copy")).alias("own"), (F.min("whole") == F.max("whole")).alias("alone")).where("own")
    starts = starts.join(own, starts["doc_id"] == own["_id"]).select("_id", "starts", "alone")
    joined = given.join(starts, given["doc_id"] == starts["_id"]).select("doc_id", "text", "starts", "alone")

    def named(cols: dict) -> dict:
        # an id tells its row, unless it stands for several texts
        return {**cols, "row": pa.array([0 if one else _row_hash(b" ".join(t.as_py().split())) for t, one in zip(cols["text"], cols["alone"].to_pylist())], pa.int64())}

    candidates = stage(map_batches(joined, named, "doc_id long, row long, text binary, starts array<struct<a:long,b:long>>", "text"), "candidates")
    gone = repeated_windows(candidates, window).groupBy("doc_id", "row").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "ranges")
    hit = candidates.drop("starts").join(gone, (F.col("doc_id") == F.col("_id")) & (F.col("row") == F.col("_row"))).select("doc_id", "text", "ranges")

    def cut(cols: dict) -> dict:
        out: dict[str, list] = {"whole": [], "removed": [], "n_removed": [], "kept_sha256": []}
        for t, r in zip(cols["text"], cols["ranges"]):
            words = t.as_py().split()
            a, b = merged(*(np.array(x) for x in zip(*((x["a"], x["b"]) for x in r.as_py()))))
            kept, at = [], 0
            for i, j in zip(a.tolist(), b.tolist()):
                kept += words[at:i]
                at = j
            kept += words[at:]
            out["whole"].append(hashlib.sha256(b" ".join(words)).hexdigest())
            out["removed"].append([{"a": i, "b": j} for i, j in zip(a.tolist(), b.tolist())])
            out["n_removed"].append(len(words) - len(kept))
            out["kept_sha256"].append(hashlib.sha256(b" ".join(kept)).hexdigest())
        spans = pa.array(out["removed"], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))
        return {"_id": cols["doc_id"], "_whole": pa.array(out["whole"]), "removed": spans, "n_removed": pa.array(out["n_removed"], pa.int64()), "kept": pa.array(out["kept_sha256"])}

    found = map_batches(hit, cut, "_id long, _whole string, removed array<struct<a:long,b:long>>, n_removed long, kept string", "text")
    found = found.groupBy("_id", "_whole").agg(F.first("removed").alias("removed"), F.first("n_removed").alias("n_removed"), F.first("kept").alias("kept"))
    end = rows.join(found, (rows["doc_id"] == found["_id"]) & (rows["whole"] == found["_whole"]), "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return end.select(
        "doc_id", "whole", "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(~F.col("copy"), F.coalesce("removed", F.array().cast("array<struct<a:long,b:long>>"))).alias("removed"),
        F.when(F.col("copy"), F.lit(nothing)).otherwise(F.coalesce("kept", "whole")).alias("kept_sha256"),
    )


def kept_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars", window: int = 50) -> DataFrame:
    """The documents without the words that substring_dedup() removes, space-joined where any go; documents that
    lose all their words are left out. Columns stay, of any names; n_chars, if there, is counted anew. Rows of one id go
    by their own words. Very long texts are cut whole. An empty table stays empty."""
    of, sums, removed, every, kept = (fresh(x) for x in ("id", "sum", "removed", "all", "kept"))
    found = substring_dedup(docs, doc_id, text, window).where("n_removed > 0").groupBy("doc_id", "whole").agg(F.first("removed").alias(removed), F.first(F.col("n_removed") == F.col("n_words")).alias(every))
    found = found.withColumnsRenamed({"doc_id": of, "whole": sums})
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    both = docs.withColumns({of: F.col(doc_id).cast("long"), sums: F.sha2(F.array_join(words, " "), 256)})
    both = both.join(found, [of, sums], "left").where(F.col(every).isNull() | ~F.col(every))
    # what is kept lies between the end of one removed range and the start of the next; the words are one value
    # that the inner function uses, so that they are split once for a row
    after = F.concat(F.array(F.lit(0).cast("long")), F.transform(removed, lambda r: r["b"]))
    before = lambda w: F.concat(F.transform(removed, lambda r: r["a"]), F.array(F.size(w).cast("long")))
    left = F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.zip_with(after, before(w), lambda i, j: F.slice(w, (i + 1).cast("int"), (j - i).cast("int")))), " "))[0]
    changed = F.col(removed).isNotNull()
    out = both.withColumn(kept, F.when(changed, left))
    new = {text: F.when(changed, F.col(kept)).otherwise(F.col(text))}
    if n_chars in docs.columns:
        new[n_chars] = F.when(changed, F.length(kept).cast(docs.schema[n_chars].dataType)).otherwise(F.col(n_chars))
    return out.withColumns(new).select(*[F.col(f"`{c}`") for c in docs.columns])
