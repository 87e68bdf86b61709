"""Conversation prefix trie: adaptive radix trees over ranges of sorted keys.

A turn's id is the first 16 bytes of the SHA-256 of its role and text, so a conversation is a string of big-endian ids of
one width, and a prefix of turns is a prefix of bytes. Equal conversations are one key, with the number and the smallest of
their ids. Keys are dealt out by ranges of their bytes; a task puts its range into an adaptive radix tree, whose nodes grow
from 4 to 16, 48 and 256 children and keep bytes without a choice as one compressed path. Walking it gives a row for each
byte depth that is a whole number of turns, within compressed paths too.

Ranges part subtrees only along the prefixes that a range's first key shares with the key before it, or its last key with
the next. All other nodes are complete. Shared ones are sums to be added up by prefix: the range in which a prefix comes
first counts it as a child and as one text that must stay, and a key is childless unless the next key goes on from it. So
no first turn, however frequent, is a key that rows are dealt by, and a range sends on as many partial rows as its two
outer conversations have turns, at most.
"""

from __future__ import annotations

import hashlib
import itertools
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import ship, stage

WIDTH = 16
_IDS = 1 << 10  # ids that one row holds on their way to the digest
_RANGE = 1 << 18  # turns that a tree holds, on average


class Node:
    """A node of the tree: a compressed path from its parent, then a choice by one byte. Children lie in the smallest of
    four layouts: sorted bytes of up to 4 or 16, a table of 256 places for up to 48, or 256 children by byte."""

    __slots__ = ("path", "end", "keys", "kids", "sums")

    def __init__(self, path: bytes, end=None):
        self.path, self.end = path, end
        self.keys: bytearray | None = bytearray()
        self.kids: list = []

    def layout(self) -> int:
        if self.keys is None:
            return 256
        return 48 if len(self.keys) == 256 else 4 if len(self.kids) <= 4 else 16

    def child(self, byte: int) -> Node | None:
        if self.keys is None:
            return self.kids[byte]
        if len(self.keys) == 256:
            return self.kids[self.keys[byte] - 1] if self.keys[byte] else None
        at = bisect_left(self.keys, byte)
        return self.kids[at] if at < len(self.keys) and self.keys[at] == byte else None

    def put(self, byte: int, kid: Node) -> None:
        """Adds or replaces a child; a full layout grows into the next."""
        if self.keys is None:
            self.kids[byte] = kid
        elif len(self.keys) == 256:
            if self.keys[byte]:
                self.kids[self.keys[byte] - 1] = kid
            elif len(self.kids) < 48:
                self.kids.append(kid)
                self.keys[byte] = len(self.kids)
            else:
                self.kids = [self.kids[k - 1] if k else None for k in self.keys]
                self.kids[byte], self.keys = kid, None
        else:
            at = bisect_left(self.keys, byte)
            if at < len(self.keys) and self.keys[at] == byte:
                self.kids[at] = kid
            elif len(self.kids) < 16:
                self.keys.insert(at, byte)
                self.kids.insert(at, kid)
            else:
                table = bytearray(256)
                for n, b in enumerate(self.keys):
                    table[b] = n + 1
                self.keys = table
                self.put(byte, kid)

    def children(self) -> Iterator[Node]:
        """In order of their bytes."""
        if self.keys is None:
            yield from (k for k in self.kids if k is not None)
        elif len(self.keys) == 256:
            yield from (self.kids[k - 1] for k in self.keys if k)
        else:
            yield from self.kids


def insert(root: Node, key: bytes, end) -> None:
    """Puts a key with what ends there; the root's path is empty. A key that is there already is replaced."""
    node, at = root, 0
    while True:
        if at == len(key):
            node.end = end
            return
        kid = node.child(key[at])
        if kid is None:
            node.put(key[at], Node(key[at:], end))
            return
        path, same = kid.path, 0
        most = min(len(path), len(key) - at)
        if key[at : at + most] == path[:most]:
            same = most
        else:
            while path[same] == key[at + same]:
                same += 1
        if same < len(path):
            # the compressed path is cut where the keys part
            above = Node(path[:same])
            kid.path = path[same:]
            above.put(kid.path[0], kid)
            node.put(key[at], above)
            kid = above
        node, at = kid, at + same


def _same(a: bytes, b: bytes, at: int = 0) -> int:
    """How many bytes of a are those of b from place `at` on."""
    most = min(len(a), len(b) - at)
    if a[:most] == b[at : at + most]:
        return max(0, most)
    low, high = 0, most  # a[:low] is the same, a[:high] isn't
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[at + low : at + mid]:
            low = mid
        else:
            high = mid
    return low


class RangeTrie:
    """The tree of one range of keys. before and after are the keys next to the range, None where there is none."""

    def __init__(self, before: bytes | None, after: bytes | None, width: int = WIDTH):
        self.root, self.width, self.before, self.after = Node(b""), width, before, after
        self.first: bytes | None = None
        self.last: bytes | None = None

    def add(self, key: bytes, n: int, low: int, sizes, ends: str) -> None:
        insert(self.root, key, (n, low, sizes, ends))
        self.first = key if self.first is None else min(self.first, key)
        self.last = key if self.last is None else max(self.last, key)

    def _frame(self, node: Node, start: int, left: bool, right: bool) -> tuple:
        """Of a node whose path starts at byte `start`: the depths it has, how many of them are shared with ranges before
        and in all, and whether the end of its path is on the path of the first and of the last key."""
        deepest = (start + len(node.path)) // self.width
        top = start // self.width + 1 if start or node is not self.root else 0
        f = _same(node.path, self.first, start) if left else -1
        g = _same(node.path, self.last, start) if right else -1
        early = min(deepest, self.shared_left, (start + f) // self.width) if left else -1
        late = min(deepest, self.shared_right, (start + g) // self.width) if right else -1
        return top, deepest, early, max(early, late), left and f == len(node.path), right and g == len(node.path)

    def nodes(self):
        """(conv_id, depth, parent, n, kids, leaves, saved, ends, prefix, parent prefix) of each node. Where prefix, a
        SHA-256, isn't None the row is this range's share; where only the parent's isn't, the parent is such a row."""
        if self.first is None:
            return
        w = self.width
        self.shared_left = -1 if self.before is None else _same(self.before, self.first) // w
        self.shared_right = -1 if self.after is None else _same(self.last, self.after) // w
        goes_on = self.after is not None and self.after.startswith(self.last)
        # up the tree: what each node has below its path
        stack = [(self.root, 0, True, True, self.root.children())]
        self.root.sums = [0, None, 0, 0, 0, None]
        while stack:
            node, start, left, right, rest = stack[-1]
            kid = next(rest, None)
            if kid is not None:
                end = start + len(node.path)
                *_, l, r = self._frame(node, start, left, right)
                kid.sums = [0, None, 0, 0, 0, None]
                stack.append((kid, end, l, r, kid.children()))
                continue
            stack.pop()
            top, deepest, early, _, _, r = self._frame(node, start, left, right)
            s = node.sums
            if node.end is not None:
                s[0] += node.end[0]
                s[1] = node.end[1] if s[1] is None else min(s[1], node.end[1])
                s[5] = node.end[2]
            if not node.kids:
                s[3] = 0 if r and goes_on and start + len(node.path) == len(self.last) else 1
            if stack:
                up, saved = stack[-1][0].sums, s[4]
                for d in range(top, deepest + 1):
                    saved += (s[0] - (d > early)) * (s[5][d - 1] if d else 0)
                up[0] += s[0]
                up[1] = s[1] if up[1] is None else min(up[1], s[1])
                up[2] += int(top > early) if top <= deepest else s[2]
                up[3] += s[3]
                up[4] += saved
                up[5] = s[5]
        # and down: rows, each with its parent
        frames = [(self.root, 0, True, True, None, None, b"")]
        while frames:
            # mark hashes the prefix of the last shared node above, pend holds the bytes that follow it
            node, start, left, right, parent, mark, pend = frames.pop()
            top, deepest, early, shared, l, r = self._frame(node, start, left, right)
            n, low, kids, leaves, below, sizes = node.sums
            saved = below + sum((n - (d > early)) * (sizes[d - 1] if d else 0) for d in range(top, deepest + 1))
            at = start
            for d in range(top, deepest + 1):
                up = mark and mark.digest()
                ends = node.end[3] if node.end is not None and d == deepest and d * w == start + len(node.path) else None
                below_kids = kids if d == deepest else int(d + 1 > early)
                if d <= shared:
                    mark = mark.copy() if mark else hashlib.sha256()
                    mark.update(pend + node.path[at - start : d * w - start])
                    at, pend = d * w, b""
                    yield low, d, None, n, below_kids, leaves, saved, ends, mark.digest(), up
                else:
                    yield low, d, None if up else parent, n, below_kids, leaves, saved, ends, None, up
                    mark = None
                parent = low
                saved -= (n - (d > early)) * (sizes[d - 1] if d else 0)
            pend = pend + node.path[at - start :] if mark else b""
            for kid in node.children():
                frames.append((kid, start + len(node.path), l, r, parent, mark, pend))


def rebuilt_conversations(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str, every: int, heads: int) -> DataFrame:
    """(conv_id, key, sizes): each conversation with the first turns of another in front."""
    c = conversations.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).where("conv_id is not null")
    named = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    c = c.withColumns({"id": F.substring(named, 1, 2 * WIDTH), "size": F.length("text")})
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    own = c.withColumn("n", nth).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("n", "id", "size"))).alias("turns"))
    own = stage(own, "trie-turns")
    first = own.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("of"), F.slice("turns", 1, heads - 1).alias("head"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("int")
    both = own.withColumns({"h": h, "at": F.col("conv_id") - F.col("conv_id") % every}).join(first, F.col("at") == F.col("of"), "left")
    none = F.expr("cast(array() as array<struct<n:int,id:string,size:int>>)")
    # a slice of length 0 is allowed, one that starts at 0 isn't
    turns = F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.greatest(F.lit(0), F.size("turns") - F.col("h"))))
    both = both.select("conv_id", turns.alias("turns"))
    return both.select("conv_id", F.unhex(F.array_join(F.col("turns.id"), "")).alias("key"), F.col("turns.size").alias("sizes"))


def _stream(rows: DataFrame, fold, schema: str) -> DataFrame:
    """mapInArrow over single rows in order: fold(iterator of tuples) -> iterator of tuples."""
    ship(rows.sparkSession)
    names, kinds = zip(*[c.split() for c in schema.split(", ")])
    types = {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = fold(r for b in batches for r in zip(*[c.to_pylist() for c in b.columns]))
        while some := list(itertools.islice(out, 4096)):
            yield pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(zip(*some), kinds)], names)

    return rows.mapInArrow(run, schema)


def _packed(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(digest, conv_id, key, sizes) in order -> (digest, smallest id, number of ids, ids, key, sizes), some ids a row."""
    for digest, run in itertools.groupby(rows, lambda r: r[0]):
        while some := list(itertools.islice(run, _IDS)):
            yield digest, some[0][1], len(some), ",".join([str(r[1]) for r in some]).encode(), some[0][2], some[0][3]


def _joined(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Packed rows in order -> (key, sizes, n, low, ends), one row a key."""
    for _, run in itertools.groupby(rows, lambda r: r[0]):
        h, n, first = hashlib.sha256(), 0, None
        for r in run:
            h.update(b"," + r[3] if n else r[3])
            n, first = n + r[2], first or r
        yield first[4], first[5], n, first[1], h.hexdigest()


def prefix_nodes(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", every: int = 100, heads: int = 6, turns_a_range: int = _RANGE) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row a node.

    Conversation c starts with the first crc32(c) % heads turns of c - c % every, and goes on with its own after as many.
    Turns go by turn, null first, then role and text; null roles and texts are empty. Rows without a conv_id belong to no
    conversation. Equal rows are turns each. A conversation whose turns are all left out is a member of the root alone.
    The turns of one conversation are put in order by one task. An empty table gives an empty result, without a root.
    Other columns aren't read.
    """
    convs = stage(rebuilt_conversations(conversations, conv_id, turn, role, text, every, heads), "trie-conversations")
    # equal keys are joined in two steps, since a digest of ids in order is made in one task: packs of ids first
    packs = convs.select(F.sha2("key", 256).alias("digest"), "conv_id", "key", "sizes").repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id")
    packs = _stream(packs, _packed, "digest string, low long, n long, ids binary, key binary, sizes array<int>")
    keys = _stream(packs.repartition("digest").sortWithinPartitions("digest", "low"), _joined, "key binary, sizes array<int>, n long, low long, ends string")
    keys = stage(keys, "trie-keys")
    n_ranges = max(1, -(-(keys.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0) // turns_a_range))
    ranges = stage(keys.repartitionByRange(n_ranges, "key").withColumn("range", F.spark_partition_id()), "trie-ranges")
    # a row a range; a range knows the keys next to it
    by_range = Window.orderBy("range")
    bounds = ranges.groupBy("range").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    bounds = bounds.select("range", F.lag("last").over(by_range).alias("before"), F.lead("first").over(by_range).alias("after"))
    names = "conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, prefix binary, parent binary"
    kinds = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]] for c in names.split(", ")]

    def grow(keys: pa.Table, bounds: pa.Table) -> pa.Table:
        trie = RangeTrie(bounds["before"][0].as_py(), bounds["after"][0].as_py())
        for row in zip(*[keys[c].to_pylist() for c in ("key", "n", "low", "sizes", "ends")]):
            trie.add(*row)
        columns = list(zip(*trie.nodes()))
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], [c.split()[0] for c in names.split(", ")])

    nodes = stage(ranges.groupBy("range").cogroup(bounds.groupBy("range")).applyInArrow(grow, names), "trie-nodes")
    whole = nodes.where("prefix is null")
    add = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    shared = stage(nodes.where("prefix is not null").groupBy("prefix").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), *add, F.max("ends_sha256").alias("ends_sha256")), "trie-shared")
    ups = shared.select(F.col("prefix").alias("_prefix"), F.col("conv_id").alias("_conv_id"))
    below = whole.where("parent is not null").drop("prefix").unionByName(shared.withColumn("parent_conv_id", F.lit(None).cast("long")).drop("prefix"))
    below = below.join(ups, F.col("parent") == F.col("_prefix"), "left").withColumn("parent_conv_id", F.col("_conv_id"))
    out = whole.where("parent is null").select(*below.drop("parent", "_prefix", "_conv_id").columns).unionByName(below.drop("parent", "_prefix", "_conv_id"))
    ends = F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest()))
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends.alias("ends_sha256"))
