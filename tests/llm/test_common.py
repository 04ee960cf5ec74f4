import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import common


@settings(deadline=None)
@given(st.lists(st.integers(0, 4), max_size=60), st.integers(1, 9), st.sampled_from([None, 1, 3]))
def test_runs_are_whole_groups_or_full_pieces(keys, size, most):
    keys = sorted(keys)
    batches = [pa.RecordBatch.from_pydict({"k": pa.array(keys[i : i + size], pa.int64()), "i": pa.array(range(i, min(i + size, len(keys))), pa.int64())}) for i in range(0, len(keys), size)]
    got = list(common.runs(iter(batches), 1, most))
    assert [i for t in got for i in t["i"].to_pylist()] == list(range(len(keys)))
    for table in got:
        assert len(set(table["k"].to_pylist())) == 1
    sizes = {k: [t.num_rows for t in got if t["k"][0].as_py() == k] for k in set(keys)}
    for k, found in sizes.items():
        n = int(np.sum(np.array(keys) == k))
        assert found == ([n] if most is None else [most] * (n // most) + ([n % most] if n % most else []))


def test_saved_tables_are_in_the_shared_folder(spark):
    path = common.save(spark.range(3), "x")
    assert path.startswith(common.shared_dir(spark)) and spark.read.parquet(path).count() == 3
    common.remove(spark, path)
    assert common.materialize(spark.range(0), "y").count() == 0


def test_clear_deletes_what_the_application_saved(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path))
    path = common.save(spark.range(3), "x")
    assert spark.read.parquet(path).count() == 3
    common.clear(spark)
    assert not (tmp_path / "lectern" / spark.sparkContext.applicationId).exists()
