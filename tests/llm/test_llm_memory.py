"""What tasks hold at once, whatever the size of their input."""

import random

import pyarrow.parquet as pq
import pytest

from easel.llm import language_model as L
from easel.llm.queries import tokenizer_path


def test_word_batches_are_staged_in_small_row_groups(spark, monkeypatch):
    """A row is a batch of megabytes, and a row group of 100 of them, as Parquet makes unasked, outgrows an executor."""
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(f"{rng.getrandbits(40):x}" for _ in range(350_000))) for i in range(8)], "doc_id long, text string").coalesce(1)
    real = L.stage

    class Staged(Exception):
        pass

    def stage(df, name, **how):
        raise Staged(real(df, name, **how)._staged_path)

    monkeypatch.setattr(L, "stage", stage)
    with pytest.raises(Staged) as found:
        L.score_documents(docs, tokenizer_path("piece_bpe_32k.model"))
    found = [f.metadata for f in pq.ParquetDataset(str(found.value).removeprefix("file://")).fragments]
    groups = [m.row_group(i).num_rows for m in found for i in range(m.num_row_groups)]
    assert sum(groups) >= 4 and max(groups) <= 2
