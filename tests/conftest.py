import os
import sys
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [str(ROOT), os.environ.get("PYTHONPATH", "")]))

DATA = Path("/root/testdata/sf0.001")
LONG = "Ein sehr langer Satz ohne Ende, " * 3000


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "3").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def _extra(table: pa.Table) -> pa.Table:
    """With columns whose names the operators use inside."""
    for name in ("shard", "idx", "form", "pieces", "salt", "k", "_prev", "n_tokens", "bucket", "label_"):
        if name not in table.column_names:
            table = table.append_column(name, pa.array(["x"] * table.num_rows, pa.string()))
    return table


def _dirty(table: pa.Table) -> pa.Table:
    """Some rows, each column null in one of them, a row of nulls, repeats, empty and very long texts."""
    rows = table.slice(0, 40).to_pylist()
    if not rows:
        return table
    out = list(rows)
    for i, name in enumerate(table.column_names):
        out.append(rows[i % len(rows)] | {name: None})
    out += [{n: None for n in table.column_names}, *rows[:5], *rows[:5]]
    for i, name in enumerate(c.name for c in table.schema if pa.types.is_string(c.type) and c.name in ("text", "translated_text", "source_text")):
        out += [rows[i] | {name: ""}, rows[i + 1] | {name: "   "}, rows[i + 2] | {name: LONG}, rows[i + 3] | {name: "字" * 5000}]
    for c in table.schema:
        if pa.types.is_list(c.type):
            out.append(rows[0] | {c.name: []})
            if pa.types.is_struct(c.type.value_type):
                out.append(rows[0] | {c.name: [{f.name: None for f in c.type.value_type}]})
        if pa.types.is_floating(c.type):
            out.append(rows[0] | {c.name: float("nan")})
    return pa.Table.from_pylist(out, schema=table.schema)


@pytest.fixture(scope="session")
def data():
    if not DATA.exists():
        pytest.skip("no test tables here")
    return str(DATA)


def _written(data, folder, change):
    for path in Path(data).glob("*.parquet"):
        table = pq.read_table(path)
        # the list of notations is a fixed one
        pq.write_table(_extra(change(table)) if path.stem != "lang_names" else table, folder / path.name)
    return str(folder)


@pytest.fixture(scope="session")
def empty_dir(data, tmp_path_factory):
    return _written(data, tmp_path_factory.mktemp("empty"), lambda t: t.slice(0, 0))


@pytest.fixture(scope="session")
def dirty_dir(data, tmp_path_factory):
    return _written(data, tmp_path_factory.mktemp("dirty"), _dirty)
