"""Document likelihood under a subword lattice: all segmentations count.

A text is a sequence of words, each a space mark and its lower-cased bytes, then an end. The pieces of an existing
vocabulary and the end are drawn one by one. A piece's weight starts as what the vocabulary's scores give it, and is then
learned from the words of all training documents by expected uses over all their segmentations, a few times over; a share
of it stays the vocabulary's, whatever the corpus. As no piece goes beyond a word, the probability of a text
is the product over its words, and the end, of the sum over all ways to cut the word into pieces: a forward recursion in
log space. Single bytes are pieces too, so every text has a probability.

Texts are read once, in batches of bounded size, kept as rows: the batch's distinct words, and each document's
words as numbers in that list. A word goes to the shuffle once for each batch that has it; counts are summed before
the shuffle as well, the counts and likelihoods of all distinct words come back by a join, which adaptive execution
splits at frequent words, and a batch is put together again alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from easel.plans.ship import ship

from .shared import fold, list_array, map_batches, stage, text_bytes

_BATCH = 8 << 20
_CHUNK = 1 << 15  # words whose lattices are in memory at once
_ALONE = 1 << 10  # bytes of a word that is handled by itself


class PieceTrie:
    """Pieces of a vocabulary file as a table of moves by byte; the mark is a space. Bytes are pieces 0..255.

    before is what the vocabulary's scores say of the pieces: probabilities of a unigram vocabulary, else Zipf's law
    over the ranks that merge vocabularies have as scores; bytes come last.
    """

    def __init__(self, model_path: str):
        from sentencepiece import SentencePieceProcessor

        model, found = SentencePieceProcessor(model_file=model_path), {}
        for i in range(model.vocab_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
                p = model.id_to_piece(i).replace("▁", " ").encode()
                # words are lower-cased and have one mark, in front: other pieces are found in none
                if p == p.lower() and b" " not in p[1:]:
                    found[p] = max(found.get(p, -math.inf), model.get_score(i))
        self.pieces = [bytes([b]) for b in range(256)] + [p for p in found if len(p) > 1]
        self.longest = max(map(len, self.pieces))
        least = min(found.values(), default=0.0)
        score = np.array([found.get(p, least) for p in self.pieces])
        ranks = bool((score == np.rint(score)).all())
        before = 1 / (2 - score) if ranks else np.exp(score)
        self.before = before / before.sum()
        nodes, moves, ends = {b"": 0}, [], [(0, -1)]
        for k, p in enumerate(self.pieces):
            for j in range(1, len(p) + 1):
                if p[:j] not in nodes:
                    nodes[p[:j]] = len(nodes)
                    moves.append((nodes[p[: j - 1]], p[j - 1], nodes[p[:j]]))
            ends.append((nodes[p], k))
        self.move = np.zeros((len(nodes), 256), np.int32)
        at = np.array(moves)
        self.move[at[:, 0], at[:, 1]] = at[:, 2]
        self.move = self.move.ravel()
        self.piece = np.full(len(nodes), -1, np.int32)
        self.piece[[n for n, _ in ends[1:]]] = [k for _, k in ends[1:]]

    def matches(self, text: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, piece) of all pieces in text; left is how many bytes each start's word still has."""
        at, node = np.arange(len(text)), np.zeros(len(text), np.int64)
        out: list[list[np.ndarray]] = [[], [], []]
        for size in range(1, self.longest + 1):
            keep = left[at] >= size
            at, node = at[keep], node[keep]
            node = self.move[node * 256 + text[at + size - 1]]
            keep = node > 0
            at, node = at[keep], node[keep].astype(np.int64)
            if not len(at):
                break
            k = self.piece[node]
            hit = k >= 0
            out[0].append(at[hit]), out[1].append(np.full(hit.sum(), size)), out[2].append(k[hit])
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


@lru_cache(2)
def _trie(model_path: str) -> PieceTrie:
    return PieceTrie(model_path)


def _lay_out(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all words with marks, each word's first place (and the end), and the bytes left at each place."""
    text = np.frombuffer(b"".join([b" " + w for w in words]), np.uint8)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
    return text, starts, np.repeat(starts[1:], np.diff(starts)) - np.arange(len(text))


def expected_pieces(trie: PieceTrie, log_p: np.ndarray, words: list[bytes], weight: np.ndarray) -> np.ndarray:
    """How often each piece is used in the words, over all segmentations by their probabilities."""
    total, short = np.zeros(len(trie.pieces)), [i for i, w in enumerate(words) if len(w) < _ALONE]
    for k in range(0, len(short), _CHUNK):
        at = short[k : k + _CHUNK]
        total += _expected(trie, log_p, [words[i] for i in at], weight[at])
    for w, times in zip(words, weight.tolist()):
        if len(w) >= _ALONE:
            total += times * _long_expected(trie, log_p, w)
    return total


def _expected(trie: PieceTrie, log_p: np.ndarray, words: list[bytes], weight: np.ndarray) -> np.ndarray:
    text, starts, left = _lay_out(words)
    at, size, piece = trie.matches(text, left)
    word = np.repeat(np.arange(len(words)), np.diff(starts))[at]
    # a word has one place more than bytes, so that its end isn't the next one's start
    i, j, gain = at + word, at + size + word, log_p[piece]
    begin, end = starts[:-1] + np.arange(len(words)), starts[1:] + np.arange(len(words))
    ahead = _summed(len(text) + len(words), begin, i, j, gain, j - begin[word])
    back = _summed(len(text) + len(words), end, j, i, gain, end[word] - i)
    used = np.exp(ahead[i] + gain + back[j] - ahead[end][word]) * weight[word]
    return np.bincount(piece, used, len(trie.pieces))


def _summed(n: int, ready: np.ndarray, come: np.ndarray, go: np.ndarray, gain: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Log sums over all paths of steps come -> go from the places `ready`, all words at once by their steps."""
    out = np.full(n, -np.inf)
    out[ready] = 0.0
    o = np.lexsort((go, step))
    come, go, gain, step = come[o], go[o], gain[o], step[o]
    cuts = np.append(np.flatnonzero(np.concatenate([[True], step[1:] != step[:-1]])), len(step))
    for a, b in zip(cuts[:-1], cuts[1:]):
        v, e = out[come[a:b]] + gain[a:b], go[a:b]
        c = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]]))
        top = np.maximum.reduceat(v, c)
        out[e[c]] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, np.diff(np.append(c, len(v))))), c))
    return out


def _long_expected(trie: PieceTrie, log_p: np.ndarray, word: bytes) -> np.ndarray:
    """The same for one word, place by place."""
    text, _, left = _lay_out([word])
    at, size, piece = trie.matches(text, left)
    sides = []
    for come, go, first in ((at, at + size, 0), (at + size, at, len(text))):
        alpha, ways = [0.0] * (len(text) + 1), {}
        o = np.argsort(go if first == 0 else -go, kind="stable")
        last = None
        for i, j, gain in zip(come[o].tolist(), go[o].tolist(), log_p[piece[o]].tolist()):
            if j != last:
                if last is not None:
                    alpha[last] = _log_sum(ways.pop(last))
                ways[j], last = [], j
            ways[j].append(alpha[i] + gain)
        alpha[last] = _log_sum(ways.pop(last))
        sides.append(np.array(alpha))
    used = np.exp(sides[0][at] + log_p[piece] + sides[1][at + size] - sides[0][-1])
    return np.bincount(piece, used, len(trie.pieces))


def word_likelihoods(trie: PieceTrie, log_p: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Natural logs of the summed probability of all segmentations of each word."""
    out, short = np.zeros(len(words)), [i for i, w in enumerate(words) if len(w) < _ALONE]
    for k in range(0, len(short), _CHUNK):
        at = short[k : k + _CHUNK]
        out[at] = _likelihoods(trie, log_p, [words[i] for i in at])
    for i, w in enumerate(words):
        if len(w) >= _ALONE:
            out[i] = _long_likelihood(trie, log_p, w)
    return out


def _long_likelihood(trie: PieceTrie, log_p: np.ndarray, word: bytes) -> float:
    """The same recursion for one word, place by place."""
    text, _, left = _lay_out([word])
    at, size, piece = trie.matches(text, left)
    o = np.argsort(at + size, kind="stable")
    alpha, here, ways = [0.0] * (len(text) + 1), 1, []
    for i, j, gain in zip(at[o].tolist(), (at + size)[o].tolist(), log_p[piece[o]].tolist()):
        if j != here:
            alpha[here] = _log_sum(ways)
            here, ways = j, []
        ways.append(alpha[i] + gain)
    return _log_sum(ways)


def _log_sum(x: list[float]) -> float:
    top = max(x)
    return top + math.log(sum([math.exp(v - top) for v in x])) if len(x) > 1 else top


def _likelihoods(trie: PieceTrie, log_p: np.ndarray, words: list[bytes]) -> np.ndarray:
    text, starts, left = _lay_out(words)
    at, size, piece = trie.matches(text, left)
    word = np.repeat(np.arange(len(words)), np.diff(starts))
    end = at + size
    # places are handled by their distance from the word's start: all words take a step together
    step = end - starts[word[at]]
    o = np.lexsort((end, step))
    at, end, step, gain = at[o], end[o], step[o], log_p[piece[o]]
    # alpha of a word's end is kept at its last byte plus one; a start is 0 by itself
    alpha = np.zeros(len(text) + 1)
    first = np.zeros(len(text) + 1, bool)
    first[starts[:-1]] = True
    result = np.zeros(len(words))
    cuts = np.append(np.flatnonzero(np.concatenate([[True], step[1:] != step[:-1]])), len(step))
    for i, j in zip(cuts[:-1], cuts[1:]):
        a, e = at[i:j], end[i:j]
        v = np.where(first[a], 0.0, alpha[a]) + gain[i:j]
        c = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]]))
        top = np.maximum.reduceat(v, c)
        got = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, np.diff(np.append(c, len(v))))), c))
        place, own = e[c], word[a[c]]
        whole = place == starts[own + 1]
        result[own[whole]] = got[whole]
        alpha[place[~whole]] = got[~whole]
    return result


def read_batches(docs: DataFrame, doc_id: str, text: str, folds: int, held_out: int) -> DataFrame:
    """A row for each batch of texts: distinct words, their counts in training documents, and by document the
    numbers and counts of its words."""

    def run(cols: dict) -> dict:
        index: dict[bytes, int] = {}
        number, lengths, counts, tokens = [], [], [], []
        for t in cols["text"]:
            words = t.as_py().lower().split()
            n, c = np.unique(np.fromiter((index.setdefault(w, len(index)) for w in words), np.int32, len(words)), return_counts=True)
            number.append(n), counts.append(c.astype(np.int32)), lengths.append(len(n)), tokens.append(len(words))
        train = ~np.array(cols["held_out"].to_pylist(), bool)
        number, flat = np.concatenate(number), np.concatenate(counts)
        c_train = np.bincount(number, flat * np.repeat(train, lengths), len(index)).astype(np.int32)
        words = list(index)
        run.n += 1
        at = (TaskContext.get().partitionId() << 40) + run.n
        one = lambda x: list_array(x, [len(x)])
        return {
            "batch": pa.array([at], pa.int64()), "words": pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(words, pa.binary())), "c": one(c_train),
            "n_train": pa.array([int(train.sum())], pa.int64()), "train_tokens": pa.array([int(np.array(tokens)[train].sum() + train.sum())], pa.int64()),
            "ids": pa.ListArray.from_arrays(pa.array([0, len(lengths)], pa.int32()), cols["doc_id"]), "held_out": pa.ListArray.from_arrays(pa.array([0, len(lengths)], pa.int32()), cols["held_out"]),
            "lengths": one(np.array(lengths, np.int32)), "number": one(number), "times": one(flat),
        }

    run.n = 0
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("text"), (fold(doc_id, folds) == held_out).alias("held_out"))
    schema = "batch long, words array<binary>, c array<int>, n_train long, train_tokens long, ids array<long>, held_out array<boolean>, lengths array<int>, number array<int>, times array<int>"
    return map_batches(rows, run, schema, "text", _BATCH)


def piece_weights(trie: PieceTrie, used: np.ndarray, n_docs: int, prior: float) -> tuple[np.ndarray, float]:
    """(natural log probabilities of the pieces, that of the end). The end has its share of all draws, counted once more;
    the pieces share the rest by their uses, and a share `prior` of it as the vocabulary's scores say."""
    uses = used.sum()
    end = (n_docs + 1) / (uses + n_docs + 2)
    p = (1 - prior) * used / uses + prior * trie.before if uses else trie.before
    return np.log(p * (1 - end)), math.log(end)


def piece_uses(words: DataFrame, model_path: str, log_p: np.ndarray) -> np.ndarray:
    """Expected uses of all pieces in words (word, n): sums of a task's words first, then a number a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, total = _trie(model_path), 0.0
        for b in batches:
            total = total + expected_pieces(trie, log_p, b.column("word").to_pylist(), b.column("n").to_numpy().astype(float))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at] if len(at) else [], pa.float64())], ["piece", "used"])

    ship(words.sparkSession)
    used = np.zeros(len(_trie(model_path).pieces))
    for r in words.select("word", "n").mapInArrow(run, "piece long, used double").groupBy("piece").agg(F.sum("used").alias("used")).collect():  # the vocabulary's length at most
        used[r["piece"]] = r["used"]
    return used


def score_documents(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text", folds: int = 5, held_out: int = 1, prior: float = 0.02, passes: int = 3) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row, base 10 logs.

    Documents whose crc32 of the id leaves `held_out` modulo `folds` teach nothing. base_score is the smoothed
    word model, score the lattice's. Null and empty texts are the end alone. Long texts are read whole, one at a time.
    Repeated rows and rows with a null id (its id text is empty) get a row each and count each. An empty table gives an
    empty result. Without training documents counts are 0 and pieces weigh what the vocabulary's scores say. Other
    columns of docs aren't read.
    """
    batches = stage(read_batches(docs, doc_id, text, folds, held_out), "word-batches", large=True)
    # a word's place is its batch and its number there
    each = batches.select("batch", F.posexplode(F.arrays_zip("words", "c")).alias("at", "w")).select(F.col("w.words").alias("word"), "batch", "at", "w.c")
    words = stage(each.groupBy("word").agg(F.sum("c").alias("n")), "words")

    sums = batches.agg(F.sum("n_train").alias("docs"), F.sum("train_tokens").alias("tokens")).first()
    n_docs, n_tokens = sums["docs"] or 0, sums["tokens"] or 0
    distinct = words.where("n > 0").count() + (n_docs > 0)
    # expectation and maximisation from the vocabulary's own weights on
    trie = _trie(model_path)
    log_p, log_end = piece_weights(trie, np.zeros(len(trie.pieces)), n_docs, prior)
    for k in range(passes if n_docs else 0):
        log_p, log_end = piece_weights(trie, piece_uses(words.where("n > 0"), model_path, log_p if k else np.log(trie.before)), n_docs, prior)
    scale = math.log10(n_tokens + 0.5 * (distinct + 1))

    def likelihoods(cols: dict) -> dict:
        return {"word": cols["word"], "n": cols["n"], "likely": word_likelihoods(_trie(model_path), log_p, cols["word"].to_pylist())}

    likely = map_batches(words, likelihoods, "word binary, n long, likely double").withColumnRenamed("word", "_word")
    known = each.drop("c").join(likely, F.col("word") == F.col("_word")).select(F.col("batch").alias("of"), "at", "n", "likely")

    def put_together(batch: pa.Table, words: pa.Table) -> pa.Table:
        b = {k: batch.column(k)[0].values for k in ("ids", "held_out", "lengths", "number", "times")}
        lengths, number, times = (b[k].to_numpy().astype(np.int64) for k in ("lengths", "number", "times"))
        c, likely = np.zeros(words.num_rows, np.int64), np.zeros(words.num_rows)
        at = words.column("at").to_numpy()
        c[at], likely[at] = words.column("n").to_numpy(), words.column("likely").to_numpy()
        row = np.repeat(np.arange(len(lengths)), lengths)
        add = lambda x: np.bincount(row, x, len(lengths))
        tokens = add(times).astype(np.int64) + 1
        n_known = add(times * (c[number] > 0)).astype(np.int64) + (n_docs > 0)
        base = add(times * np.log10(c[number] + 0.5)) + math.log10(n_docs + 0.5) - tokens * scale
        score = (add(times * likely[number]) + log_end) / math.log(10)
        return pa.table([b["ids"], b["held_out"], pa.array(tokens), pa.array(n_known), pa.array(np.full(len(tokens), n_tokens)), pa.array(base), pa.array(score)], names)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    names = [c.split()[0] for c in schema.split(", ")]
    sides = batches.select("batch", "ids", "held_out", "lengths", "number", "times").groupBy("batch"), known.groupBy("of")
    return sides[0].cogroup(sides[1]).applyInArrow(put_together, schema)
