"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its hashed words, runs of 2 and 3 words, and character n-grams; a softmax
over the two classes follows, whose constants are the classes' shares. Vectors and weights are trained together by
stochastic gradient descent in numpy, on a bounded sample of labelled documents whose features are counted by the
executors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import labelled_sample
from .shared import fold, list_array, map_batches, text_bytes
from .substrings import window_hashes, word_hashes

BUCKETS = 1 << 18
_RUNS = (1, 2, 3)
_NGRAMS = (2, 3, 4)
_PIECE = 1 << 22


def _bucket(h: np.ndarray) -> np.ndarray:
    """The top bits of hashes, once these depend on all their bits."""
    return ((h ^ h >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 18)).astype(np.int64)


def features(text: bytes) -> list[np.ndarray]:
    """Bucket numbers of a text's words, of its runs of 2 and 3 words in their order, and of its character n-grams. Very
    long texts are taken in pieces of 4 million n-gram starts; a text without characters has none."""
    out, words = [np.zeros(0, np.int64)], text.split()
    if words:
        h = word_hashes(words)
        out += [_bucket(window_hashes(h, n) + np.uint64(n)) for n in _RUNS]
    letters = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    for at in range(0, len(letters), _PIECE):
        b = letters[at : at + _PIECE + max(_NGRAMS) - 1].copy()
        b[(b >= 9) & (b <= 13)] = 32
        h = b
        for n in range(2, max(_NGRAMS) + 1):
            h = h[:-1] * np.uint32(0x01000193) ^ b[n - 1 :] if len(h) > 1 else h[:0]
            if n in _NGRAMS:
                out.append(((h[:_PIECE] * np.uint32(0x9E3779B1)) >> np.uint32(32 - 18)).astype(np.int64))
    return out


def gradient(vectors: np.ndarray, classes: np.ndarray, constants: np.ndarray, share: np.ndarray, label: int) -> tuple[float, np.ndarray, np.ndarray]:
    """(loss, its gradient by the vectors of the document's buckets, and by the classes' weights) of one document."""
    hidden = share @ vectors
    logits = classes @ hidden + constants
    p = np.exp(logits - logits.max())
    p /= p.sum()
    loss = -float(np.log(max(p[label], 1e-300)))
    p[label] -= 1
    return loss, np.outer(share, p @ classes), np.outer(p, hidden)


def train(docs: list[tuple[np.ndarray, np.ndarray, int]], dim: int = 8, epochs: int = 12, rate: float = 0.4, seed: int = 3, buckets: int = BUCKETS) -> tuple[np.ndarray, float]:
    """(the weight of each bucket: its vector times the difference of the two classes' weights; the constant's weight).

    docs: (buckets, shares that sum to 1, label). One document a step, in a new seeded order each epoch, against the
    gradient; the rate falls to 0, and for the vectors it is over the squared length of the shares, so that a long
    document moves its hidden vector as far as a short one. The constants are the logs of the classes' shares, each
    counted once more, and stay. No documents give weights of 0, a score of a half.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim))
    classes = np.zeros((2, dim))
    constants = np.log(np.bincount([y for *_, y in docs], minlength=2) + 1.0)
    steps, step = max(1, epochs * len(docs)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            at, share, label = docs[i]
            if len(at):
                lr = rate * (1 - step / steps)
                _, by_vectors, by_classes = gradient(vectors[at], classes, constants, share, label)
                classes -= lr * by_classes
                vectors[at] -= lr / (share @ share) * by_vectors
            step += 1
    return vectors @ (classes[1] - classes[0]), float(constants[1] - constants[0])


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", most: int = 4000, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row; score is the probability of label 1.

    Fitted on at most `most` labelled documents outside the held-out fold (crc32 of the id modulo 5 is 0). Null
    and empty texts score the share of label 1 in the sample, but for one of each label added. Long texts are scored whole. Repeated rows and null ids get a row
    each. Without labels every score is a half. An empty table gives an empty result. Other columns of docs aren't read.
    """

    def counted(cols: dict) -> dict:
        at, share, lengths = [], [], []
        for t in cols["text"]:
            n = np.bincount(np.concatenate(features(t.as_py())), minlength=1)
            at.append(np.flatnonzero(n).astype(np.int32))
            share.append((n[at[-1]] / max(1, n.sum())).astype(np.float32))
            lengths.append(len(at[-1]))
        return {"doc_id": cols["doc_id"], "label": cols["label"], "at": list_array(np.concatenate(at), lengths), "share": list_array(np.concatenate(share), lengths)}

    sample = map_batches(labelled_sample(docs, labels, label, most, doc_id, text), counted, "doc_id long, label int, at array<int>, share array<float>", "text").toArrow().combine_chunks().sort_by("doc_id")
    weight, constant = train([(a.values.to_numpy(), s.values.to_numpy().astype(float), y.as_py()) for a, s, y in zip(sample["at"], sample["share"], sample["label"])])

    def scored(cols: dict) -> dict:
        out = []
        for t in cols["text"]:
            total = n = 0
            for f in features(t.as_py()):
                total, n = total + weight[f].sum(), n + len(f)
            out.append(1 / (1 + np.exp(-np.clip(total / max(1, n) + constant, -500, 500))))
        return {"doc_id": cols["doc_id"], "held_out": cols["held_out"], "score": pa.array(out, pa.float64())}

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("text"), (fold(doc_id) == 0).alias("held_out"))
    return map_batches(rows, scored, "doc_id long, held_out boolean, score double", "text").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
