"""Vector files and lines."""

import numpy as np
import pytest

from tidewater.sources import vectors as S


def test_fvecs_over_files(spark, tmp_path):
    x = np.arange(40, dtype=np.float32).reshape(10, 4)
    (tmp_path / "a.fvecs").write_bytes(S.encode(x[:6], "fvecs"))
    (tmp_path / "b.fvecs").write_bytes(S.encode(x[6:], "fvecs"))
    rows = S.read(spark, f"file://{tmp_path}", "fvecs", 4).orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(10)) and np.array([r["v"] for r in rows]).tolist() == x.tolist()
    part = S.read(spark, f"file://{tmp_path}", "fvecs", 4, skip=2, limit=3, loops=2).orderBy("id").collect()
    assert [r["id"] for r in part] == [2, 3, 4, 5, 6, 7] and part[3]["v"] == part[0]["v"]


def test_bvecs_signs_and_errors(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a").write_bytes(S.encode([[200, 1]], "bvecs"))
    path = f"file://{tmp_path}/x"
    assert S.read(spark, path, "bvecs", 2).first()["v"] == [200.0, 1.0]
    assert S.read(spark, path, "bvecs", 2, signed=True).first()["v"] == [-56.0, 1.0]
    with pytest.raises(ValueError):
        S.read(spark, path, "bvecs", 5)
    (tmp_path / "x" / "a").write_bytes(S.encode([[1, 2, 3, 4, 5, 6, 7, 8]], "bvecs"))
    with pytest.raises(Exception, match="dimension"):
        S.read(spark, path, "bvecs", 2).collect()


def test_ivecs_truth(spark, tmp_path):
    (tmp_path / "t.ivecs").write_bytes(S.encode([[5, 3, 9], [1, 2, 4]], "ivecs"))
    got = {r["query_id"]: r["ids"] for r in S.truth(S.read(spark, f"file://{tmp_path}", "ivecs", 3), 2).collect()}
    assert got == {0: [5, 3], 1: [1, 2]}


def test_lines(spark):
    lines = ["i 4,1.5,2", "d 7", "q 9,0.25,1", "12,3,4", "13", "", "d 8,1,2"]
    got = [(r["op"], r["id"], r["v"]) for r in S.parse(spark.createDataFrame([(x,) for x in lines], "value string")).collect()]
    assert got == [("I", 4, [1.5, 2.0]), ("D", 7, None), ("Q", 9, [0.25, 1.0]), ("I", 12, [3.0, 4.0]), ("D", 13, None), ("D", 8, [1.0, 2.0])]
