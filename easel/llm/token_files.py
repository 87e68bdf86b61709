"""Token ids in binary files: ids ranked by frequency, 1 to 4 data bytes each, lengths in separate control bytes.

A file is a Parquet file of blocks, so that Spark commits it whole and reads it from any store. A block holds
whole documents in ascending id order: their ids and lengths, the token ids of the block from the most to the
least frequent, the ranks' 2-bit byte lengths four to a control byte, and the ranks' data bytes. Decoding looks
the control bytes up in a table of 256 x 4 lengths. Ranking by block needs no pass over the corpus before, and
lets each block be read alone.
"""

from __future__ import annotations

import re
import uuid
from array import array
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import map_batches, shared_dir, stage, text_bytes

_KEEP = 96 << 20  # bytes of words that a worker remembers
_SHARD = 256 << 20  # bytes of text in a shard, about
#: What byte-level vocabularies write for a byte: itself where it is visible, else a letter from 256 on.
_SEEN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SHOWN = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SEEN)}
_MARK = _SHOWN[32]
#: Words whose parts are sure: no apostrophe, no number signs that aren't digits, nothing above Latin letters.
_PLAIN = re.compile("[!-&(-~\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]+").fullmatch
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_PARTS = re.compile(f"[{_LETTER}]+|[0-9]+|[^{_LETTER}0-9]+").findall
#: The lengths less one that a control byte stands for.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8)
_BLOCK = "shard int, block long, first long, doc_ids array<long>, lengths array<int>, by_rank binary, control binary, data binary"


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit numbers."""
    r = np.ascontiguousarray(ranks, "<u4")
    code = ((r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)).astype(np.uint8)
    four = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    four[: len(r)] = code
    control = (four.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    used = np.arange(4) <= code[:, None]
    return control.tobytes(), r.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n].astype(np.int64) + 1
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4) < size[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").ravel()


class Encoder:
    """The tokenizers library, asked once per worker for each word.

    Byte-level splitting starts a new part at a single space or line feed between visible characters, and between
    letters, digits and other signs. So words are split at such places, and a part that isn't remembered is merged
    by the library's model alone, with its space. Words with an apostrophe or characters above Latin letters go to
    the whole library, and so do texts with other white space, and all texts of other tokenizers.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        before = spec["pre_tokenizer"] or {}
        self.apart = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not spec["normalizer"] and not spec["truncation"] and not spec["padding"] and spec["model"].get("type") == "BPE"
        self.merge = self.library.model.tokenize
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.width = np.dtype("<u2") if self.library.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        #: ids of words, each after a space or the line feed that it begins with, and of parts without either
        self.words: dict[str, bytes] = {}
        self.plain: dict[str, bytes] = {}
        self.room = _KEEP
        #: texts that match this get the library whole: white space that isn't one character between visible ones,
        #: or that libraries may see differently, and the tokenizer's special tokens
        spaces = "".join(re.escape(c) for c in map(chr, range(0x10000)) if (c.isspace() or c == "\u180e") and c not in " \n")
        self.odd = "|".join(["^$", "^[ \n]", "[ \n]$", "  ", "\n\n", " \n", "\n ", f"[{spaces}]", *map(re.escape, self.special)])
        self.code = "H" if self.width.itemsize == 2 else "I"

    @cached_property
    def feed(self) -> bytes:
        return array(self.code, self.library.encode("\n", add_special_tokens=False).ids).tobytes()

    def _part(self, part: str, before: str) -> bytes:
        """The ids of letters, digits or signs alone, as the model merges them."""
        known = self.words if before else self.plain
        if (ids := known.get(part)) is None:
            if part.isascii() and part.isprintable():
                shown = _MARK + part if before else part
            else:
                shown = (before + part).encode().decode("latin-1").translate(_SHOWN)
            ids = array(self.code, [t.id for t in self.merge(shown)]).tobytes()
            self._keep(known, part, ids)
        return ids

    def _keep(self, known: dict[str, bytes], word: str, ids: bytes) -> None:
        if (cost := 160 + 2 * len(word) + len(ids)) <= self.room:
            self.room -= cost
            known[word] = ids

    def _word(self, word: str) -> bytes | None:
        """The ids of a word, after a space or the line feed that it begins with, by its parts; None if they aren't sure."""
        before, lead = " ", b""
        if word[0] == "\n":
            before, lead, word = "", self.feed, word[1:]
        if not _PLAIN(word):
            return None
        first, *rest = _PARTS(word)
        return b"".join([lead, self._part(first, before), *[self._part(x, "") for x in rest]])

    def _look_up(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words; new ones are known from then on as long as there is room."""
        known, out, ask = self.words, list(map(self.words.get, words)), []
        for i, ids in enumerate(out):
            if ids is None:
                if (ids := self._word(words[i])) is None:
                    ask.append(i)
                else:
                    out[i] = ids
                    if words[i] not in known:
                        self._keep(known, words[i], ids)
        if ask:
            asked = [words[i] if words[i][0] == "\n" else " " + words[i] for i in ask]
            for i, e in zip(ask, self.library.encode_batch_fast(asked, add_special_tokens=False)):
                out[i] = array(self.code, e.ids).tobytes()
                self._keep(known, words[i], out[i])
        return out

    def encode_all(self, texts: pa.StringArray) -> list[bytes]:
        """The ids of texts, without special tokens put around them. The distinct words are looked up at once, and
        Arrow lays their ids out in the order of the words."""
        odd = pc.match_substring_regex(texts, self.odd) if self.apart else pa.array([True] * len(texts))
        plain = texts.filter(pc.invert(odd))
        cut = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(pa.scalar("\n"), plain, ""), "\n", " \n"), " ")
        # the first word of each list is what is before the first feed: nothing
        words = pc.list_flatten(cut).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        ids = [b""] * len(distinct)
        some = [i for i, w in enumerate(distinct) if w]
        for i, x in zip(some, self._look_up([distinct[i] for i in some])):
            ids[i] = x
        laid = pa.array(ids, pa.large_binary()).take(words.indices)
        ends = np.frombuffer(laid.buffers()[1], np.int64, len(laid) + 1) if len(laid) else np.zeros(1, np.int64)
        at = ends[cut.offsets.to_numpy() - cut.offsets[0].as_py()].tolist() if len(cut) else []
        data, skip = laid.buffers()[2], len(self.feed)  # without the feed put in front
        found = iter([data[i + skip : j].to_pybytes() for i, j in zip(at, at[1:])])
        whole = iter(self.library.encode_batch_fast(texts.filter(odd).to_pylist(), add_special_tokens=False))
        return [array(self.code, next(whole).ids).tobytes() if o else next(found) for o in odd.to_pylist()]

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text]))[0]


@lru_cache(4)
def _encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work; threads besides would only compete
    return Encoder(path)


class Shards:
    """Where rows go, by id and tie: null ids first, in `nulls` shards; then a shard for each range of ids up to a cut.
    A cut that repeats is an id with a large part of the rows: it has as many shards of its own, dealt out by tie."""

    def __init__(self, cuts: list[int], nulls: int):
        self.cuts, self.own = np.unique(np.array(cuts, np.int64), return_counts=True)
        self.own = np.append(np.where(self.own > 1, self.own, 0), 0)
        self.first = nulls + np.concatenate([[0], np.cumsum(self.own[:-1] + 1)])
        self.nulls, self.n = nulls, int(self.first[-1]) + 1

    def of(self, ids: np.ndarray, null: np.ndarray, tie: np.ndarray) -> np.ndarray:
        share = (tie.astype(float) + 2.0**63) / 2.0**64
        part = lambda n: np.clip((share * n).astype(np.int64), 0, np.maximum(n - 1, 0))
        i = np.searchsorted(self.cuts, ids)
        hot = (self.own[i] > 0) & (np.append(self.cuts, 0)[i] == ids)
        return np.where(null, part(self.nulls), self.first[i] + np.where(hot, 1 + part(self.own[i]), 0)).astype(np.int32)


def byte_cuts(sizes: DataFrame, n: int, fine: int = 8) -> list[int]:
    """n - 1 ids, in order, that cut rows (id, bytes) into n parts of about as many bytes; an id that has more of them than
    a part is there as often as it fills parts.

    Ranges of ids that are heavier than a part over `fine` are cut into equal ones, again and again, until they are light
    or one id. A pass sums bytes by range in each task first; the driver gets about `fine` numbers a part in each.
    """
    ends = sizes.agg(F.min("id").alias("low"), F.max("id").alias("high"), F.sum("bytes").alias("bytes")).first()
    if ends["low"] is None or n < 2:
        return []
    target = max(1, ends["bytes"] / n)
    light, heavy = [], [(ends["low"], ends["high"], ends["bytes"])]
    while heavy:
        parts = [min(h - l + 1, max(2, int(fine * w / target) + 1)) for l, h, w in heavy]
        steps = [-(-(h - l + 1) // k) for (l, h, _), k in zip(heavy, parts)]
        lows, highs = (np.array([r[i] for r in heavy], np.int64) for i in (0, 1))
        step, base = np.array(steps, np.uint64), np.concatenate([[0], np.cumsum(parts)])

        def weigh(cols: dict) -> dict:
            ids, size = cols["id"].to_numpy(), cols["bytes"].to_numpy()
            i = np.maximum(np.searchsorted(lows, ids, "right") - 1, 0)
            own = (ids >= lows[i]) & (ids <= highs[i])
            i, ids, size = i[own], ids[own], size[own]
            # the distance from a range's start, whatever the signs
            at = base[i] + ((ids.view(np.uint64) - lows[i].view(np.uint64)) // step[i]).astype(np.int64)
            found, where = np.unique(at, return_inverse=True)
            return {"at": pa.array(found), "bytes": pa.array(np.bincount(where, size, len(found)).astype(np.int64))}

        got = map_batches(sizes, weigh, "at long, bytes long").groupBy("at").agg(F.sum("bytes").alias("bytes")).toArrow().combine_chunks()
        again = []
        for k, w in zip(got["at"].to_pylist(), got["bytes"].to_pylist()):
            r = int(np.searchsorted(base, k, "right")) - 1
            low = heavy[r][0] + (k - int(base[r])) * steps[r]
            high = min(heavy[r][1], low + steps[r] - 1)
            (again if w > target / fine and high > low else light).append((low, high, w))
        heavy = sorted(again)
    light.sort()
    reached = np.cumsum([w for *_, w in light])
    return [light[i][1] for i in np.searchsorted(reached, target * np.arange(1, n)).clip(0, len(light) - 1)]


def tokenize(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, shards: Shards | None = None) -> DataFrame:
    """(doc_id, tie, ids, width, shard): the ids with end_id, as little-endian numbers of 2 bytes, or of 4 where the
    vocabulary needs it; tie is a hash of the text, which orders rows of one id."""
    shards = shards or Shards([], 0)

    def run(cols: dict) -> dict:
        e = _encoder(tokenizer_path)
        end = np.array([end_id], e.width).tobytes()
        try:
            texts = cols["text"].cast(pa.string())
        except pa.ArrowInvalid:  # not UTF-8 somewhere
            texts = pa.array([t.as_py().decode("utf-8", "replace") for t in cols["text"]], pa.string())
        ids = [x + end for x in e.encode_all(texts)]
        shard = shards.of(pc.fill_null(cols["doc_id"], 0).to_numpy(), cols["doc_id"].is_null().to_numpy(zero_copy_only=False), cols["tie"].to_numpy())
        return {"doc_id": cols["doc_id"], "tie": cols["tie"], "ids": pa.array(ids, pa.binary()), "width": pa.array([e.width.itemsize] * len(ids), pa.int32()), "shard": pa.array(shard)}

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("tie"), text_bytes(text).alias("text"))
    return map_batches(rows, run, "doc_id long, tie long, ids binary, width int, shard int", "text", 8 << 20)


def _block(shard: int, block: int, first: int, doc_ids: pa.Array, lengths: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    n = np.bincount(ids)
    by_rank = np.argsort(-n, kind="stable")[: np.count_nonzero(n)].astype("<u4")
    rank = np.zeros(len(n), np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    control, data = pack(rank[ids])
    one = [0, len(lengths)]
    lists = [pa.ListArray.from_arrays(pa.array(one, pa.int32()), x) for x in (doc_ids, pa.array(lengths, pa.int32()))]
    plain = [pa.array([v], k) for v, k in ((shard, pa.int32()), (block, pa.int64()), (first, pa.int64()))]
    return pa.RecordBatch.from_arrays([*plain, *lists, *[pa.array([x], pa.binary()) for x in (by_rank.tobytes(), control, data)]], [c.split()[0] for c in _BLOCK.split(", ")])


def _flat(ids: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers of a binary column, how many each row has)."""
    ends = np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1, 4 * ids.offset).astype(np.int64)
    return np.frombuffer(ids.buffers()[2], f"<u{width}", (ends[-1] - ends[0]) // width, ends[0]), np.diff(ends) // width


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, block_tokens: int = 1 << 20, shard_bytes: int = _SHARD) -> None:
    """Tokenize and write files at path, ids in ascending order (null first, ties by a hash of the text, then by the
    token ids). There are as many shards as shuffle partitions, or one for each shard_bytes of text if that is more,
    cut by bytes of text; the driver holds a few numbers and one id a shard and, in reading, one number a shard."""
    sizes = stage(docs.select(F.col(doc_id).cast("long").alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("bytes")), "token-sizes")
    seen = sizes.agg(F.sum(F.when(F.col("id").isNull(), F.col("bytes"))).alias("nulls"), F.sum("bytes").alias("bytes")).first()
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(seen["bytes"] or 0) // shard_bytes))
    shards = Shards(byte_cuts(sizes.where("id is not null"), n), -(-n * (seen["nulls"] or 0) // max(1, seen["bytes"] or 0)))

    def blocks(batches):
        shard, block, first, held, size = None, 0, 0, [], 0

        def close():
            return _block(shard, block, first, pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]))

        for b in batches:
            if not b.num_rows:
                continue
            ids, lengths = _flat(b.column("ids"), b.column("width")[0].as_py())
            own, ends = b.column("shard").to_numpy(), np.cumsum(lengths)
            at = 0
            while at < b.num_rows:
                if held and (own[at] != shard or size >= block_tokens):
                    yield close()
                    block, first, held, size = block + 1, first + size, [], 0
                if own[at] != shard:
                    shard, block, first = int(own[at]), 0, 0
                before = int(ends[at - 1]) if at else 0
                # rows of this shard until the block is full
                full = int(np.searchsorted(ends, before + block_tokens - size)) + 1
                to = min(full, at + int(np.searchsorted(own[at:], shard, "right")))
                held.append((b.column("doc_id").slice(at, to - at), lengths[at:to], ids[before : int(ends[to - 1])]))
                size, at = size + int(ends[to - 1]) - before, to
        if held:
            yield close()

    tokens = tokenize(docs, tokenizer_path, doc_id, text, end_id, shards)
    in_order = tokens.repartitionById(shards.n, "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "tie", "ids")
    in_order.drop("tie").mapInArrow(blocks, _BLOCK).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids): what the files hold; start is the number of ids of all documents before it, ids
    are little-endian unsigned 32-bit numbers."""
    blocks = spark.read.schema(_BLOCK).parquet(path)
    # one number a shard
    sizes = blocks.groupBy("shard").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, n: s + n)).alias("n")).orderBy("shard").collect()
    base, total = {}, 0
    for r in sizes:
        base[r["shard"]] = total
        total += r["n"]

    def unpacked(cols: dict) -> dict:
        docs, texts, starts = [], [], []
        for k in range(len(cols["shard"])):
            n = cols["lengths"][k].values.to_numpy().astype(np.int64)
            control, data, by_rank = (cols[c][k].as_buffer() for c in ("control", "data", "by_rank"))
            ids = np.frombuffer(by_rank, "<u4")[unpack(control, data, int(n.sum()))]
            ends = np.concatenate([[0], np.cumsum(n)])
            docs.append(cols["doc_ids"][k].values)
            starts.append(ends[:-1] + cols["first"][k].as_py() + base[cols["shard"][k].as_py()])
            # a block is far smaller than the 2 GB that these places can count, unless one text isn't
            texts.append(pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(4 * ends), pa.py_buffer(ids)]).cast(pa.binary()))
        return {"doc_id": pa.concat_arrays(docs), "start": pa.array(np.concatenate(starts)), "ids": pa.concat_arrays(texts)}

    return map_batches(blocks, unpacked, "doc_id long, start long, ids binary", "data", 1 << 20)


def token_files(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, path: str | None = None) -> DataFrame:
    """Tokenize, write the files and read them back. Null and empty texts give the end id alone; rows with the
    same id or a null id are all kept. A very long text is encoded whole and lies in one block. An empty table gives files without blocks and no rows. Other columns of
    docs aren't read."""
    path = path or f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer_path, doc_id, text, end_id)
    return read_tokens(docs.sparkSession, path)
