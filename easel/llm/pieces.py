"""SentencePiece encoding and decoding with source offsets.

Text is normalised by longest prefixes of the model's compiled character map, keeping for each normalised
byte the source byte that it came from. Pieces are then projected through that record, so every piece has its
span of source bytes. No BPE piece holds a space mark behind another character, or a line feed, so merges never
cross the start of a run of marks or a line feed: units that start there are encoded once per worker and looked
up after that; the merges themselves are the library's. A model whose pieces do so gets whole texts.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import list_array, map_batches, text_bytes

MARK = "▁"
_KEEP = 64 << 20  # bytes of units that a worker remembers


class CharacterMap:
    """The compiled character map: a double array of 32-bit units, then the replacements, each ended by NUL."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.texts = blob[4 + size :]
        shift = lambda u: (u >> 10) << ((u & 512) >> 6)
        root = shift(self.units[0]) if self.units else 0
        firsts = [b for b in range(1, 256) if root ^ b < len(self.units) and self.units[root ^ b] & 0x800000FF == b]
        #: bytes up to one that a key starts with; keys start where characters do
        self.plain = re.compile(b"[^" + b"".join(re.escape(bytes([b])) for b in firsts) + b"]+" if firsts else b"(?s:.+)").match

    def longest(self, text: bytes, at: int) -> tuple[int, int]:
        """(bytes matched, place of the replacement) of the longest key that text has at `at`; (0, 0) if none."""
        units, found = self.units, (0, 0)
        if not units:
            return found
        shift = lambda u: (u >> 10) << ((u & 512) >> 6)
        node = shift(units[0])
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units) or units[node] & 0x800000FF != text[i]:
                break
            leaf = units[node] >> 8 & 1
            node ^= shift(units[node])
            if leaf:
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        return found

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them, and for the end, where in text it comes from."""
        if not self.units:
            return text, np.arange(len(text) + 1)
        out, source, i = bytearray(), [], 0
        while i < len(text):
            if m := self.plain(text, i):
                source += range(i, m.end())
                out += m[0]
                i = m.end()
                continue
            n, place = self.longest(text, i)
            if n:
                new = self.texts[place : self.texts.index(0, place)]
            else:
                n = 1
                while i + n < len(text) and text[i + n] & 0xC0 == 0x80:
                    n += 1
                new = text[i : i + n]
            source += [i + k for k in range(len(new))] if new == text[i : i + n] else [i] * len(new)
            out += new
            i += n
        return bytes(out), np.array([*source, len(text)])


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto.FromString(self.library.serialized_model_proto())
        norm = proto.normalizer_spec
        if not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("this model changes white space in a way that is not supported")
        self.map = CharacterMap(norm.precompiled_charsmap)
        kinds = [p.type for p in proto.pieces]
        self.is_byte = np.array([k == 6 for k in kinds])
        self.end_id = self.library.eos_id()
        #: what a piece becomes when decoded; and how many bytes of normalised text it stands for
        self.surface = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b"" if p.type == 3 else p.piece.replace(MARK, " ").encode() for p in proto.pieces]
        self.n_bytes = np.array([len(x) for x in self.surface], np.int32)
        self.apart = not any(MARK in p.piece.lstrip(MARK) or "\n" in p.piece for p in proto.pieces)
        self.units: dict[str, bytes] = {}
        self.room = _KEEP
        self.cut = re.compile(f"(?:{MARK}+|\n)[^{MARK}\n]*").findall

    def encode(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(ids with the end id, ends): piece i stands for source bytes ends[i - 1] .. ends[i], the first from 0."""
        normal, source = self.map.normalise(text)
        shown = normal.decode("utf-8", "replace")
        literal = MARK in shown
        marked = MARK + shown.replace(" ", MARK) if shown else ""
        units, known = (self.cut(marked) if self.apart else [marked] if marked else []), self.units
        try:
            parts = [known[u] for u in units]
        except KeyError:
            fresh = list({u for u in units if u not in known})
            asked = self.library.encode([u if u[0] == "\n" else u[1:] for u in fresh], num_threads=1)
            # the library puts a mark in front; a line feed keeps it apart, and it is none of the unit's
            got = {u: np.array(ids[1:] if u[0] == "\n" else ids, np.int32).tobytes() for u, ids in zip(fresh, asked)}
            if MARK in got:  # the library sees an empty text here
                got[MARK] = np.array([self.library.piece_to_id(MARK)], np.int32).tobytes()
            for u, x in got.items():
                if (cost := 180 + 2 * len(u) + len(x)) <= self.room:
                    self.room -= cost
                    known[u] = x
            parts = [got[u] if u in got else known[u] for u in units]
        ids = np.frombuffer(b"".join(parts), np.int32)
        ends = np.cumsum(self.n_bytes[ids]) - (1 if len(ids) else 0)  # without the mark put in front
        if literal:  # a mark that the text itself has is 3 bytes, not 1
            ends = self._with_literal_marks(ids, normal)
        ends = source[np.clip(ends, 0, len(normal))]
        return np.append(ids, np.int32(self.end_id)), np.append(ends, len(text)).astype(np.int32)

    def _with_literal_marks(self, ids: np.ndarray, normal: bytes) -> np.ndarray:
        at, ends = -1, []
        for i in ids.tolist():
            for k in range(0, len(self.surface[i])):
                at += 3 if not self.is_byte[i] and self.surface[i][k] == 32 and at >= 0 and normal[at : at + 3] == MARK.encode() else 1
            ends.append(at)
        return np.array(ends)

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.surface.__getitem__, ids))
        return text[1:].decode("utf-8", "replace") if text[:1] == b" " else text.decode("utf-8", "replace")


@lru_cache(4)
def _model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_pieces(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, ends, decoded): all ids with the end id, where each piece ends in the source's UTF-8
    bytes (it starts where the one before ends), and the text that the ids decode to.

    Null and empty texts give the end id alone and decode to ''. Long texts are encoded whole. Rows stand alone:
    repeated rows and null ids get a row each. An empty table gives an empty result. model_path is read by each worker.
    Other columns of docs aren't read.
    """

    def run(cols: dict) -> dict:
        model, got = _model(model_path), []
        for t in cols["text"]:
            got.append(model.encode(t.as_py()))
        ids, ends = np.concatenate([a for a, _ in got]), np.concatenate([b for _, b in got])
        lengths = [len(a) for a, _ in got]
        return {"doc_id": cols["doc_id"], "ids": list_array(ids, lengths), "ends": list_array(ends, lengths), "decoded": pa.array([model.decode(a.tolist()) for a, _ in got], pa.string())}

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("text"))
    return map_batches(rows, run, "doc_id long, ids array<int>, ends array<int>, decoded string", "text")
