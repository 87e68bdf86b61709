"""Toxicity of texts restored by a noisy-channel decoder.

A token is what a channel made of meant letters: it writes look-alike digits and signs for letters, repeats letters,
and puts signs and spaces between them. Each span is a lattice of what its runs of equal characters may stand for, all of
these at once; a Viterbi search under a character trigram model picks the reading, which is the span itself where nothing
else is likelier. A span is a token, single characters in a row, or neighbouring tokens whose letters at the space between
are likelier together than apart by more than such a space costs. The restored words are then scored against evidence
learned from labelled documents.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import labelled_sample
from .shared import filter_rows, fold, map_batches, scratch, stage, text_bytes

# What digits and signs commonly stand for inside words.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
#: Log probabilities of the channel: a look-alike for a letter, a sign put in that stands for nothing, a sign or space
#: between letters, a run of a letter for one or two of it, and a sign in a word that means itself.
ALIKE, DROPPED, SPACED, REPEATED, LITERAL = math.log(0.1), math.log(0.0005), math.log(0.2), math.log(0.05), math.log(0.0001)

_SIGN = re.escape("".join(LEET)).encode()
#: Tokens whose lattice has more than one path: a letter twice in a row, or a letter and something that is none.
_MANY_PATHS = re.compile(rb"([a-z])\1|[a-z\x80-\xff][^a-z\x80-\xff]|[^a-z\x80-\xff][a-z\x80-\xff]").search
_SINGLE = rb"[a-z" + _SIGN + rb"]"
_SINGLES = re.compile(rb"(?<![^\s])" + _SINGLE + rb"(?:\s+" + _SINGLE + rb")+(?![^\s.,;:?!])")
_LETTER = re.compile(rb"[a-z]").search
#: Letters that aren't repeated, together; else a run of one character, or white space.
_RUNS = re.compile(r"(?:([a-z])(?!\1)|[\x80-\xff])+|\s+|([^\s])\2*").finditer
#: Signs that stand for nothing but themselves; at the ends of a token they are the break that is there anyway.
_ENDS = bytes(b for b in range(33, 128) if not (chr(b).isalnum() or chr(b) in LEET))
_LAST = _ENDS + b"!"  # at the end, an exclamation mark is one
#: What a byte most likely stands for, one letter for all that look alike: l is one of those that look like i.
_CANON = bytes(ord("i") if chr(b) in "l1!|" else ord(LEET[chr(b)][0]) if chr(b) in LEET else b for b in range(256))
N_CLASSES = 64
_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = np.arange(1, 27)
_CLASS[128:] = 27 + np.arange(128) % 37
_CODES = _CLASS.tobytes()
_GUESS = bytes(int(_CLASS[ord(LEET[chr(b)][0])] if chr(b) in LEET else _CLASS[b]) for b in range(256))
_BLANK = bytes(b in (9, 10, 11, 12, 13, 32) for b in range(256))
_IS_LETTER = bytes(bool(c) for c in _CODES)
CLEAR = 1.5  # the log odds from which a mark is evidence
_KEEP = 48 << 20  # bytes of tokens that a worker remembers, for each of two caches


def letter_counts(text: bytes) -> np.ndarray:
    """Trigram numbers of the lower-cased text's character classes; what isn't a letter is a break, once."""
    c = _CLASS[np.frombuffer(b" " + text.lower() + b" ", np.uint8)]
    c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])].astype(np.int64)
    return c[:-2] * (N_CLASSES * N_CLASSES) + c[1:-1] * N_CLASSES + c[2:]


def letter_model(counts: np.ndarray) -> np.ndarray:
    """Log probabilities of a class after two others, mixed with those after one and after none."""
    n3 = counts.reshape(N_CLASSES, N_CLASSES, N_CLASSES).astype(float)
    n2, n1 = n3.sum(0), n3.sum((0, 1))
    p1 = (n1 + 1) / (n1.sum() + N_CLASSES)
    p2 = (n2 + 5 * p1) / (n2.sum(1, keepdims=True) + 5)
    return np.log((n3 + 5 * p2[None]) / (n3.sum(2, keepdims=True) + 5))


class Restorer:
    """starts: canonical beginnings, up to 8 letters, of the words that are looked for across spaces, None for any."""

    def __init__(self, log_p: np.ndarray, starts: set[bytes] | None = None):
        self.table, self.starts = log_p.ravel(), starts
        self.log_p, self.known, self.options, self.room = self.table.tolist(), {}, {}, _KEEP

    def option(self, c: str, n: int, alone: bool) -> list[tuple[str, bytes, float]]:
        """(text, its character classes, log probability of the channel) of what n times c may stand for; alone: no
        letter is beside it."""
        if (found := self.options.get((c, n, alone))) is not None:
            return found
        code = _CODES[ord(c) : ord(c) + 1]
        if code != b"\0":
            out = [(c * n, code * n, 0.0), *[(c * k, code * k, REPEATED) for k in (1, 2) if k < n]]
        elif c in LEET:
            out = [(c * n, b"\0", 0.0 if alone else LITERAL)]
            out += [(x * k, _CODES[ord(x) : ord(x) + 1] * k, ALIKE * k + (REPEATED if k < n else 0.0)) for x in LEET[c] for k in (1, 2) if k <= n] + [("", b"", DROPPED)]
        else:
            out = [(c * n, b"\0", 0.0)] + [("", b"", SPACED)] * (not c.isalnum())
        if n < 64:
            self.options[c, n, alone] = out
        return out

    def lattice(self, span: str) -> list[list[tuple[str, bytes, float]]]:
        """What each part of a lower-cased span may stand for: letters that don't repeat for themselves, runs of a
        character for what option() says. White space counts as one space."""
        parts = [m[0] for m in _RUNS(span)]
        letter = [False, *["a" <= x[0] <= "z" or x[0] >= "\x80" for x in parts], False]
        spaced = any(x.isspace() for x in parts)  # then the neighbours are a space away
        out = []
        for i, x in enumerate(parts):
            if letter[i + 1] and (len(x) == 1 or x[0] != x[1] or x[0] >= "\x80"):
                out.append([(x, x.encode("latin-1").translate(_CODES), 0.0)])
            elif x.isspace():
                out.append(self.option(" ", 1, False))
            else:
                out.append(self.option(x[0], len(x), not (spaced or letter[i] or letter[i + 2])))
        return out

    def best(self, lattice: list) -> tuple[float, str]:
        """(log probability, reading) of the likeliest path, between breaks. A state is the two classes before."""
        lp = self.log_p
        states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        for options in lattice:
            after: dict[int, tuple[float, tuple | None]] = {}
            for state, (score, before) in states.items():
                for text, codes, cost in options:
                    at, s = state, score + cost
                    for k in codes:
                        if k or at & 63:  # breaks in a row are one
                            s += lp[at * 64 + k]
                            at = at * 64 + k & 4095
                    old = after.get(at)
                    if old is None or s > old[0]:
                        after[at] = (s, (before, text))
            states = after
        score, chain = max(((s + (lp[at * 64] if at & 63 else 0.0), c) for at, (s, c) in states.items()), key=lambda e: e[0])
        parts = []
        while chain:
            chain, text = chain
            parts.append(text)
        return score, "".join(reversed(parts))

    def restore(self, span: bytes) -> bytes:
        """The most likely reading of a span; itself if it has no letter."""
        if (found := self.known.get(span)) is None:
            found = self.best(self.lattice(span.decode("latin-1")))[1].encode("latin-1") if _LETTER(span) else span
            if (cost := 200 + len(span) + len(found)) <= self.room:
                self.room -= cost
                self.known[span] = found
        return found

    def token(self, token: bytes) -> bytes:
        """The reading of a lower-cased token, without punctuation at its ends."""
        token = token.rstrip(_LAST).lstrip(_ENDS)
        return self.restore(token) if _MANY_PATHS(token) else token

    def joined(self, text: bytes) -> list[tuple[int, int]]:
        """Where spans lie of neighbouring tokens with letters of a lower-cased text at whose spaces letters, or what looks like them, are likelier
        side by side than with a break between, by more than a space in a word costs."""
        blank = np.frombuffer((b" " + text + b" ").translate(_BLANK), np.uint8)
        edges = np.flatnonzero(blank[1:] != blank[:-1])
        first, last = edges[::2], edges[1::2] - 1
        if len(first) < 2:
            return []
        g, lp = np.frombuffer(text.translate(_GUESS), np.uint8), self.table
        e, s, n = last[:-1], first[1:], N_CLASSES
        a, c = g[e].astype(np.int64), g[s].astype(np.int64)
        z, d = np.where(e > first[:-1], g[e - 1], 0).astype(np.int64), np.where(s < last[1:], g[np.minimum(s + 1, len(g) - 1)], 0)
        gain = lp[(z * n + a) * n + c] + lp[(a * n + c) * n + d] - lp[(z * n + a) * n] - lp[a * n * n + c] - lp[c * n + d]
        at = np.flatnonzero((gain + SPACED > 0) & (a > 0) & (c > 0))
        if not len(at):
            return []
        # a number is no part of a word
        has = np.logical_or.reduceat(np.frombuffer(text.translate(_IS_LETTER), bool), first)
        at = at[has[at] & has[at + 1]]
        # spaces in a row make one span
        cuts = np.flatnonzero(np.diff(at) > 1)
        spans = zip(at[np.concatenate([[0], cuts + 1])].tolist(), at[np.concatenate([cuts, [len(at) - 1]])].tolist()) if len(at) else ()
        places = [(int(first[i]), int(last[j + 1]) + 1) for i, j in spans]
        return places if self.starts is None else [(i, j) for i, j in places if self._wanted(text[i:j].translate(_CANON).split())]

    def _wanted(self, tokens: list[bytes]) -> bool:
        """Whether some word looked for may start in one of a span's tokens and go on in the next."""
        for k in range(len(tokens) - 1):
            size = len(tokens[k])
            if size < 8:
                joined = b"".join(tokens[k : k + 9 - size])[:8]
                for n in range(max(3, size + 1), len(joined) + 1):
                    if joined[:n] in self.starts:
                        return True
        return False

    def tokens(self, text: bytes) -> set[bytes]:
        """The distinct lower-cased tokens of a text, and the words that single characters in a row, and tokens that may
        belong together, are read as."""
        text = text.lower()
        out = set(text.split())
        for m in _SINGLES.finditer(text):
            out.update(self.restore(m[0]).split())
        for i, j in self.joined(text):
            out.update(self.restore(text[i:j]).split())
        return out

    def __call__(self, text: bytes) -> bytes:
        """The lower-cased text restored, white space as single spaces."""
        joined = _SINGLES.sub(lambda m: self.restore(m[0]), text.lower())
        for i, j in reversed(self.joined(joined)):
            joined = joined[:i] + self.restore(joined[i:j]) + joined[j:]
        return b" ".join(map(self.token, joined.split()))


_EDGES = re.compile(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(restored: bytes) -> set[bytes]:
    """Distinct words: runs of lower-case letters, digits and non-ASCII bytes."""
    return set(_EDGES.sub(b" ", restored).split())


def marks(word: bytes) -> list[bytes]:
    """What a word is known by: itself, and its beginnings of 3 to 8 characters."""
    w = word.decode("utf-8", "replace")
    return [word, *(w[:k].encode() + b"-" for k in range(3, min(9, len(w))))]


def learn(held: Iterable[tuple[bytes, int, int]], n: tuple[int, int], least: int = 4) -> dict[bytes, float]:
    """Evidence for label 1: log odds of documents with a mark, over those without, where it is clear. held: marks, and how
    many of the n documents of labels 0 and 1 hold each.

    A mark counts when at least `least` documents of label 1 and at least 1 in 100 of them hold it.
    """
    out = {}
    for m, k0, k1 in held:
        if k1 >= max(least, n[1] / 100):
            w = math.log((k1 + 0.5) / (n[1] + 1)) - math.log((k0 + 0.5) / (n[0] + 1))
            if w > CLEAR:
                out[m] = w
    return out


_NOTHING: dict[bytes, float] = {}


class Evidence:
    """Features of a document from the evidence of its tokens' words; what a token says is looked up once."""

    def __init__(self, weights: dict[bytes, float], restorer: Restorer | None = None):
        self.weights, self.restorer, self.known, self.room = weights, restorer, {}, _KEEP
        self.starts = {m[:3] for m in weights}  # every mark of a word starts as the word does

    def of(self, token: bytes) -> dict[bytes, float]:
        """The words of a token (restored, if there is a restorer) that are evidence, and of how much."""
        found = self.known.get(token)
        if found is None:
            found = {}
            for w in words_of(self.restorer.token(token) if self.restorer else token):
                if w[:3] in self.starts and (e := max((self.weights.get(m, 0.0) for m in marks(w)), default=0.0)):
                    found[w] = e
            if (cost := 150 + len(token) + 200 * bool(found)) <= self.room:
                self.room -= cost
                self.known[token] = found or _NOTHING
        return found

    def features(self, tokens: set[bytes]) -> list[float]:
        known, found = self.known, {}
        for t in tokens:
            e = known.get(t)
            if e is None:
                e = self.of(t)
            if e:
                found.update(e)
        top = sorted(found.values(), reverse=True)
        first = top[0] if top else 0.0
        return [1.0, first / 4, sum(top[1:3]) / 8, math.log1p(sum(x > 3 for x in top)), math.log1p(len(tokens)) / 8]


def _counted_marks(sample: DataFrame, side, n: np.ndarray, least: int = 4) -> list[tuple[bytes, list[int]]]:
    """(mark, number of documents of each side that hold it), by mark, for marks that may be evidence in a half or in
    both: at least 1 in 100 documents of label 1 hold each, so a text's length doesn't bring many."""

    def counted(cols: dict) -> dict:
        held: dict[bytes, list[int]] = {}
        for words, s in zip(cols["words"], side(cols["doc_id"], cols["label"])):
            for m in {m for w in words.as_py().split() for m in marks(w)}:
                held.setdefault(m, [0] * 4)[s] += 1
        return {"mark": pa.array(list(held), pa.binary())} | {f"n{s}": pa.array([k[s] for k in held.values()], pa.int64()) for s in range(4)}

    def may_be(sides: list[tuple[int, int]]) -> Column:
        k0, k1 = (sum((F.col(f"n{x[y]}") for x in sides), F.lit(0)) for y in (0, 1))
        all0, all1 = (int(sum(n[x[y]] for x in sides)) for y in (0, 1))
        return (k1 >= max(least, all1 / 100)) & (F.log((k1 + 0.5) / (all1 + 1)) - F.log((k0 + 0.5) / (all0 + 1)) > CLEAR - 1e-6)  # learn() has the last word

    rows = map_batches(sample, counted, "mark binary, n0 long, n1 long, n2 long, n3 long", "words", 1 << 20)
    rows = rows.groupBy("mark").agg(*[F.sum(f"n{s}").alias(f"n{s}") for s in range(4)])
    got = rows.where(may_be([(0, 1)]) | may_be([(2, 3)]) | may_be([(0, 1), (2, 3)])).toArrow().combine_chunks().sort_by("mark")
    return list(zip(got["mark"].to_pylist(), zip(*[got[f"n{s}"].to_pylist() for s in range(4)])))


def fit(sample: DataFrame, rounds: int = 400, seed: int = 3) -> tuple[dict[bytes, float], np.ndarray]:
    """(evidence, logistic weights) from rows (doc_id, label, words, space-joined): the weights are fitted on documents whose
    evidence comes from the other half. Words stay with the executors; the driver gets two numbers and five features a
    row, and counts of the marks that may be evidence."""
    rows = sample.select("doc_id", "label").toArrow().combine_chunks().sort_by("doc_id")
    ids, y = rows["doc_id"].to_numpy(), rows["label"].to_numpy()
    if not len(ids):
        return {}, np.zeros(5)
    half = np.random.default_rng(seed).permutation(len(ids)) % 2
    n = np.bincount(2 * half + y, minlength=4)

    def halves(doc_id: pa.Array) -> np.ndarray:
        return half[np.searchsorted(ids, doc_id.to_numpy())]

    held = _counted_marks(sample, lambda doc_id, label: (2 * halves(doc_id) + label.to_numpy()).tolist(), n)
    others = [learn(((m, k[2 - 2 * h], k[3 - 2 * h]) for m, k in held), (n[2 - 2 * h], n[3 - 2 * h])) for h in (0, 1)]

    def featured(cols: dict) -> dict:
        e = [Evidence(w) for w in others]
        x = [e[h].features(set(words.as_py().split())) for words, h in zip(cols["words"], halves(cols["doc_id"]).tolist())]
        return {"doc_id": cols["doc_id"], "x": pa.array(x, pa.list_(pa.float64()))}

    x = map_batches(sample, featured, "doc_id long, x array<double>", "words").toArrow().combine_chunks().sort_by("doc_id")["x"]
    order, w = np.argsort(half, kind="stable"), np.zeros(5)
    x, y = np.array(x.to_pylist())[order], y[order]
    for _ in range(rounds):  # Newton steps with a small ridge settle within a few
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-2 * np.eye(5), x.T @ (p - y) + 1e-2 * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return learn(((m, k[0] + k[2], k[1] + k[3]) for m, k in held), (n[0] + n[2], n[1] + n[3])), w


class Scorer:
    """Scores of texts; what it remembers of tokens stays in the worker."""

    def __init__(self, model: np.ndarray, evidence: dict[bytes, float], weights: np.ndarray):
        self.model, self.evidence, self.weights = model, evidence, weights.tolist()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "found"}

    def scores(self, texts: list[bytes]) -> list[float]:
        if "found" not in self.__dict__:
            self.found = Evidence(self.evidence, Restorer(self.model, {m.rstrip(b"-")[:8].translate(_CANON) for m in self.evidence}))
        e, out = self.found, []
        for t in texts:
            z = sum(x * w for x, w in zip(e.features(e.restorer.tokens(t)), self.weights))
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        return out


def train_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", most: int = 6000) -> Scorer:
    """The character model of all documents outside the held-out fold (crc32 of the id modulo 5 is 0), and evidence
    from at most `most` labelled ones of these. Without labels every score is a half."""
    rows = docs.select(text_bytes(text).alias("text"), (fold(doc_id) == 0).alias("held_out")).where("not held_out").select("text")

    def letters(cols: dict) -> dict:
        n = np.zeros(N_CLASSES**3, np.int64)
        for t in cols["text"]:
            n += np.bincount(letter_counts(t.as_py()), minlength=len(n)) if len(t.as_py()) > 1 << 18 else 0
        small = [letter_counts(t.as_py()) for t in cols["text"] if len(t.as_py()) <= 1 << 18]
        n += np.bincount(np.concatenate([np.zeros(0, np.int64), *small]), minlength=len(n))
        at = np.flatnonzero(n)
        return {"at": pa.array(at), "n": pa.array(n[at])}

    counts = np.zeros(N_CLASSES**3)
    got = map_batches(rows, letters, "at long, n long", "text").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # 64^3 rows at most
    counts[got["at"].to_numpy()] = got["n"].to_numpy()
    model = letter_model(counts).astype(np.float32)

    def restored(cols: dict) -> dict:
        r = Restorer(model)
        words = [b" ".join(sorted({w for x in r.tokens(t.as_py()) for w in words_of(r.token(x))})) for t in cols["text"]]
        return {"doc_id": cols["doc_id"], "label": cols["label"], "words": pa.array(words, pa.binary())}

    sample = map_batches(labelled_sample(docs, labels, label, most, doc_id, text), restored, "doc_id long, label int, words binary", "text")
    with scratch():
        return Scorer(model, *fit(stage(sample, "toxicity-sample")))


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", most: int = 6000, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row; score is the probability of label 1 by train_toxicity().

    Null and empty texts score what a text without words does; long texts are scored whole, one at a time. Repeated
    rows and null ids get a row each. An empty table gives an empty result. Other columns of docs aren't read.
    """
    scorer = train_toxicity(docs, labels, label, doc_id, text, most)

    def scored(cols: dict) -> dict:
        return {"doc_id": cols["doc_id"], "held_out": cols["held_out"], "score": pa.array(scorer.scores([t.as_py() for t in cols["text"]]), pa.float64())}

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("text"), (fold(doc_id) == 0).alias("held_out"))
    return map_batches(rows, scored, "doc_id long, held_out boolean, score double", "text").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def clean_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that score_toxicity() doesn't predict toxic, each row by its own text, whatever its id; all columns
    stay, of any names. Very long texts are scored whole. An empty table stays empty."""
    scorer = train_toxicity(docs, labels, doc_id=doc_id, text=text)
    return filter_rows(docs, text, lambda texts: [s < threshold for s in scorer.scores(texts)])
