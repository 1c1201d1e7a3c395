from __future__ import annotations

import sys
from datetime import datetime
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from check import session  # noqa: E402
from reelmetrics.sources.domain import OrderShop  # noqa: E402
from reelmetrics.sources.tables import SCHEMAS  # noqa: E402

ARROW = {
    "int": pa.int32(),
    "bigint": pa.int64(),
    "double": pa.float64(),
    "string": pa.string(),
    "timestamp_ntz": pa.timestamp("us"),
}
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = session("4")
    s.conf.set("spark.sql.shuffle.partitions", "2")
    yield s
    s.stop()


def ts(text):
    """'2000-01-02' or '2000-01-02 10:30' as datetime; None stays None."""
    if text is None:
        return None
    return datetime.fromisoformat(text)


@pytest.fixture
def frame(spark):
    def make(schema, rows):
        names = [c.split()[1] for c in schema.split(", ")]
        values = [
            tuple(ts(v) if kind == "timestamp_ntz" else v for v, kind in zip(row, names)) for row in rows
        ]
        return spark.createDataFrame(values, schema)

    return make


@pytest.fixture
def shop(spark, tmp_path):
    """A hand-made shop: keyword arguments give rows per base table, others are tiny defaults."""

    defaults = {
        "region": [(0, "NORTH"), (1, "SOUTH")],
        "nation": [(0, "ANN", 0), (1, "BOB", 1)],
        "customer": [(1, "Ada", 0, 0.0, "KING"), (2, "Ben", 1, 0.0, "LEE")],
        "supplier": [(1, "S1", 0, 0.0), (2, "S2", 1, 0.0)],
        "part": [(1, "red fox", "B", "DRAMA", 5, 1.0), (2, "blue fox", "B", "ACTION", 3, 1.0)],
        "orders": [],
        "lineitem": [],
        "events": [],
    }

    def make(as_of="2001-08-01", **given):
        for name, schema in SCHEMAS.items():
            kinds = [c.strip().split() for c in schema.split(",")]
            given_rows = given.get(name, defaults[name])
            columns = {
                column: pa.array([ts(r[i]) if kind == "timestamp_ntz" else r[i] for r in given_rows], ARROW[kind])
                for i, (column, kind) in enumerate(kinds)
            }
            pq.write_table(pa.table(columns), f"{tmp_path}/{name}.parquet")
        return OrderShop(spark, str(tmp_path), as_of)

    return make


def order(key, customer, date, amount=0.0):
    return (key, customer, "O", amount, date, "1")


def line(order_key, film, copy, amount, shipped, returned=True, flag="R"):
    return (order_key, film, copy, 1, 1.0, amount, 0.0, 0.0, flag, "F" if returned else "O", shipped)


def rows(df, *columns):
    chosen = df.select(*columns) if columns else df
    return sorted(map(tuple, chosen.collect()), key=lambda r: [(v is not None, v) for v in r])
