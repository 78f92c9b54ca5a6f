"""Every core query against its SQL, on empty tables and on dirty ones."""

import math

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from segmenta.plans import catalogue
from tests.compare import differences

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, data, name):
    assert not differences(spark, QUERIES[name], SQL[name], data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_dir, name):
    rows = QUERIES[name](spark, empty_dir).collect()
    assert rows == [] or name in ("emotion_bucket",) or all(x in (None, 0, [], False) or isinstance(x, str) for r in rows for x in r)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_dirty_tables(spark, dirty_dir, name):
    QUERIES[name](spark, dirty_dir).collect()


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_quality_gate_without_source_syllables(spark, data, tmp_path):
    """Recordings whose sources have no syllables in all are degraded, with the ratio of the SQL; none is lost."""
    segments, memo = (pq.read_table(f"{data}/{name}.parquet") for name in ("gold_segments", "translations"))
    cases = {"r0": [(0, 5)], "r1": [(0, 0)], "r2": [(0, 3), (0, 0)], "r3": [(0, 2), (4, 2)], "r4": [(None, 7)], "r5": [(0, None)], "r6": [(10, 0)]}
    s, m = segments.slice(0, 1).to_pylist()[0], memo.slice(0, 1).to_pylist()[0]
    own = [s | {"seg_id": i, "rec_id": r, "seg_idx": 0, "start_s": 1.0, "end_s": 2.0, "text": "x"} for i, r in enumerate(cases)]
    pairs = [(r, a, b) for r, rows in cases.items() for a, b in rows]
    lines = [m | {"trans_id": i, "rec_id": r, "source_syllables": a, "target_syllables": b} for i, (r, a, b) in enumerate(pairs)]
    pq.write_table(pa.Table.from_pylist(own, schema=segments.schema), tmp_path / "gold_segments.parquet")
    pq.write_table(pa.Table.from_pylist(lines, schema=memo.schema), tmp_path / "translations.parquet")
    found = {r.rec_id: r for r in QUERIES["quality_gate"](spark, str(tmp_path)).collect()}
    assert {k: r.length_ratio for k, r in found.items() if k != "r1"} == {"r0": math.inf, "r2": math.inf, "r3": 1.0, "r4": None, "r5": None, "r6": 0.0}
    assert math.isnan(found["r1"].length_ratio)
    assert {k: (r.status, r.reasons) for k, r in found.items()} == {k: ("success", []) if k == "r3" else ("degraded", ["length_ratio"]) for k in cases}
    assert not differences(spark, QUERIES["quality_gate"], SQL["quality_gate"], str(tmp_path))
