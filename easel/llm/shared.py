"""Helpers that the operators of this folder share: byte columns, word rules, Arrow batches and sorted runs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from easel.plans.components import components
from easel.plans.ship import ship
from easel.plans.staging import scratch, shared_dir, stage, unstage

__all__ = ["components", "filter_rows", "fold", "fresh", "list_array", "map_batches", "map_runs", "scratch", "shared_dir", "stage", "text_bytes", "unstage"]

#: What parts words, for every operator here.
SPACE = r"[\x20\x09-\x0D]"


def text_bytes(col: str) -> Column:
    """The text as UTF-8 bytes; null becomes empty."""
    return F.coalesce(F.col(col).cast("binary"), F.lit(b""))


def fold(doc_id: str, n: int = 5) -> Column:
    """crc32 of the id's decimal text, modulo n: the held-out rule. A null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def fresh(name: str) -> str:
    """A column name that no given table has."""
    return f"_{name}_{uuid.uuid4().hex}"


def cuts_by_bytes(texts: pa.Array, most: int) -> list[int]:
    """Where to cut rows so that the bytes of each slice stay under `most`, or it is one row."""
    ends, cuts = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)), [0]
    while cuts[-1] < len(texts):
        before = ends[cuts[-1] - 1] if cuts[-1] else 0
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, before + most, "right"))))
    return cuts


def filter_rows(df: DataFrame, text: str, keep, most: int = 4 << 20) -> DataFrame:
    """The rows of df for which keep(list of texts as bytes, null as empty) is true: all columns stay, and no row
    leaves its partition."""
    ship(df.sparkSession)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).cast(pa.binary())
            cuts = cuts_by_bytes(texts, most)
            for i, j in zip(cuts, cuts[1:]):
                yield b.slice(i, j - i).filter(pa.array(keep([t.as_py() or b"" for t in texts.slice(i, j - i)]), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def map_batches(df: DataFrame, fn, schema: str, weight: str | None = None, most: int = 4 << 20) -> DataFrame:
    """mapInArrow over fn(dict of Arrow columns) -> dict of columns, or None for no rows.

    With weight (a binary column), fn sees so many rows at a time that their bytes stay under `most`, or one row.
    """
    ship(df.sparkSession)
    names = T._parse_datatype_string(schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cuts = [0, b.num_rows] if weight is None else cuts_by_bytes(b.column(weight), most)
            for i, j in zip(cuts, cuts[1:]):
                if j > i and (got := fn({n: b.column(n).slice(i, j - i) for n in b.schema.names})) is not None:
                    yield pa.RecordBatch.from_arrays([got[n] if isinstance(got[n], pa.Array) else pa.array(got[n]) for n in names], names)

    return df.mapInArrow(run, schema)


def map_runs(df: DataFrame, keys: list[str], order: list[str], fn, schema: str, hold: int = 1 << 16) -> DataFrame:
    """fn over batches of whole runs of equal keys, sorted by keys and order; dict of numpy columns in and out.

    Rows are dealt out by keys[0] and streamed in sorted order; a batch ends where keys[0] changes.
    """
    ship(df.sparkSession)
    names = T._parse_datatype_string(schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, need, cols = [], 0, hold, df_columns
        for b in batches:
            held.append({c: b.column(c).to_numpy(zero_copy_only=False) for c in cols})
            size += b.num_rows
            if size >= need:
                whole = {c: np.concatenate([h[c] for h in held]) for c in cols}
                k = whole[keys[0]]
                cut = int(np.searchsorted(k, k[-1]))
                held, size = [{c: x[cut:] for c, x in whole.items()}], len(k) - cut
                need = max(hold, 2 * size)
                if cut:
                    got = fn({c: x[:cut] for c, x in whole.items()})
                    yield pa.RecordBatch.from_arrays([pa.array(got[n]) for n in names], names)
        if size:
            got = fn({c: np.concatenate([h[c] for h in held]) for c in cols})
            yield pa.RecordBatch.from_arrays([pa.array(got[n]) for n in names], names)

    df_columns = df.columns
    return df.repartition(keys[0]).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def list_array(values: np.ndarray, lengths) -> pa.Array:
    """A list column from its flat values and each row's length."""
    ends = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
