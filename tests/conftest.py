from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]")
        .appName("loomcast-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("lineage")))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def make_panel(spark):
    """Panel from {id: [values]}, weekly from a Monday; ids are `C-W-P`."""
    import datetime as dt

    def build(series: dict[str, list], price: dict[str, list] | None = None, end=None):
        rows = []
        for key, values in series.items():
            c, w, p = (int(x) for x in key.split("-"))
            start = dt.date(2020, 1, 6)
            for i, v in enumerate(values):
                pr = price[key][i] if price else None
                rows.append((c, w, p, start + dt.timedelta(weeks=i), None if v is None else float(v), pr, key))
        return spark.createDataFrame(
            rows, "Client int, Warehouse int, Product int, date date, sales double, price double, id string"
        )

    return build
