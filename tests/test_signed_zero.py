"""Small negative numbers round to -0.0 as in the independent engine."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from compare import engine

from loomspark import registry

VECTORS = [
    [-1e-7, 0.5, 0.25, -2e-8],
    [-0.0, 1.0, 2.0, -0.0],
    [0.0, 0.0078125, 0.0, 0.0],
    [1e-7, -3.0, 3.0, 1e-7],
    [float("inf"), -1.5e-6, 0.0, 2.0],
    [3e38, -2.5e-7, -2.5e-7, 3e38],
    [-1e-4, 0.0, 0.0, 1e-4],
    [],
]


@pytest.mark.parametrize("name", ["vec_add", "vec_dot", "vec_sum"])
def test_sign_of_zero(name, spark, sf_dir, tmp_path):
    n = len(VECTORS)
    table = pa.table({"vec_id": pa.array(range(n), pa.int64()), "label": pa.array(range(n), pa.int32()), "embedding": pa.array(VECTORS, pa.list_(pa.float32()))})
    pq.write_table(table, tmp_path / "embeddings.parquet")
    con = engine(sf_dir)
    con.execute(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    want = {k: v for k, v in con.execute(registry.ORACLE[name]).fetchall() if v != []}
    got = {r[0]: r[1] for r in registry.QUERIES[name](spark, str(tmp_path)).collect() if r[1] != []}
    assert {k: repr(v) for k, v in got.items()} == {k: repr(v) for k, v in want.items()}
    assert "-0.0" in repr(list(want.values()))
