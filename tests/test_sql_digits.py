"""Values on the edge of two roundings, where queries and their SQL have to take the same last digit."""

from functools import reduce

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from easel.functions import pixels as PX
from easel.plans import pixel_queries as Q
from easel.plans import registry


def both(spark, tmp_path, name, vectors):
    """The rows of a query and of its SQL, on one thread, over a table of these vectors, by key."""
    table = pa.table({"vec_id": pa.array(range(len(vectors)), pa.int64()), "embedding": pa.array([[float(x) for x in v] for v in vectors], pa.list_(pa.float32())), "label": pa.array([0] * len(vectors), pa.int32())})
    pq.write_table(table, tmp_path / "embeddings.parquet")
    got = registry.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute("set threads = 1")  # sums of doubles in the order of their rows
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    rel = con.sql(registry.oracles()[name])
    at = [rel.columns.index(c) for c in got.columns]
    rows = {str(r[0]): tuple(r) for r in got.collect()}
    return rows, {str(r[at[0]]): tuple(r[i] for i in at) for r in rel.fetchall()}


def test_fused_features_to_the_last_digit(spark, tmp_path):
    v = np.random.default_rng(1).normal(size=(30000, 64)).astype(np.float32)
    got, want = both(spark, tmp_path, "k2_fuse_features", v[[14607, 23591, 5]])
    assert got == want and len(got) == 3


def test_sigmoid_to_the_last_digit(spark, tmp_path):
    got, want = both(spark, tmp_path, "m2_sigmoid", [[0.016072409227490425, 0.5], [0.000217654014704749, -0.5]])
    assert got == want and got["1"][1][0] == 0.521751663906


def test_a_resize_on_the_edge_of_two_bytes():
    """Sums of weights and bytes that end on a half: weights as f13_cover's SQL states them, added from the first on."""
    lines = [[59, 47, 3, 87, 205, 109, 252, 252], [234, 108, 30, 93, 151, 32, 6, 76], [135, 182, 105, 242, 136, 230, 44, 213], [89, 117, 211, 48, 3, 178, 243, 81]]
    con = duckdb.connect()
    con.execute("set threads = 1")
    weights = con.sql(f"with {Q._kernel('k', 8, 6, Q._LANCZOS, 3)} select o, i, w from k order by o, i").fetchall()
    want = [[max(0, min(255, round(reduce(lambda s, t: s + t, [line[i] * w for o, i, w in weights if o == place])))) for place in range(6)] for line in lines]
    assert [PX.resize_sharp(np.array([[v] for v in line], np.uint8), 1, 6)[:, 0].tolist() for line in lines] == want
