"""Alerts on arriving cells while the predictions change."""

import pytest
from pyspark.sql import functions as F

from faregrid.params import DEFAULTS
from faregrid.storage import fresh_path
from faregrid.streaming import alerts

ARRIVAL = "cluster_id int, time_bin long, revenue_total double"
KNOWN = "cluster_id int, time_bin long, revenue_pred double, margin_pred double, relative_width double"


def run(spark, batches, versions):
    """All batches, one file each; predictions of batch n are ``versions[n]``, or the last."""
    path = fresh_path(spark, "alerts-test")
    for number, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, ARRIVAL).coalesce(1)
        frame.write.parquet(f"{path}/in/part={number}")
    asked = []

    def current(batch_id):
        asked.append(batch_id)
        return spark.createDataFrame(versions[min(batch_id, len(versions) - 1)], KNOWN)

    arriving = spark.readStream.schema(ARRIVAL).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")
    alerts.start_alerts(arriving, current, f"{path}/out", f"{path}/state", DEFAULTS).awaitTermination()
    found = {(r["cluster_id"], r["time_bin"]): (r["batch"], r["reasons"]) for r in alerts.current_alerts(spark, f"{path}/out").collect()}
    waiting = sorted(tuple(r) for r in alerts.waiting_cells(spark, f"{path}/out").collect())
    return found, waiting, asked, f"{path}/out"


def test_cells_wait_for_their_prediction(spark):
    batches = [[(1, 10, 100.0), (1, 11, 100.0), (2, 10, 100.0)], [(3, 10, 5.0)]]
    first = [(1, 10, 100.0, 0.5, 0.1)]
    later = first + [(1, 11, 50.0, -0.1, 0.9)]
    found, waiting, asked, _ = run(spark, batches, [first, later])
    assert found == {(1, 11): (1, ["revenue_variance", "negative_margin", "wide_interval"])}
    assert waiting == [(2, 10, 100.0, 0), (3, 10, 5.0, 1)]
    assert asked == [0, 1]


def test_corrected_cell_is_judged_anew(spark):
    known = [(1, 10, 100.0, 0.5, 0.1), (1, 11, 100.0, 0.5, 0.1)]
    found, waiting, _, _ = run(spark, [[(1, 10, 300.0), (1, 11, 100.0)], [(1, 10, 101.0), (1, 11, 10.0)]], [known])
    assert found == {(1, 11): (1, ["revenue_variance"])}
    assert waiting == []


def test_arrival_outdoes_the_waiting_cell(spark):
    found, _, _, _ = run(spark, [[(1, 10, 300.0)], [(1, 10, 100.0)]], [[], [(1, 10, 100.0, 0.5, 0.1)]])
    assert found == {}


@pytest.mark.parametrize("revenue, reasons", [(None, None), (100.0, None)])
def test_nulls(spark, revenue, reasons):
    """Rows without a zone or bin are no cells; unknown revenue isn't off; a null margin isn't negative."""
    found, waiting, _, _ = run(spark, [[(1, 10, revenue), (None, 10, 1.0), (1, None, 1.0)]], [[(1, 10, 100.0, None, None)]])
    assert found.get((1, 10)) is reasons
    assert waiting == []


def test_only_touched_cells_are_written(spark):
    known = [(1, n, 100.0, 0.5, 0.1) for n in range(50)]
    batches = [[(1, n, 1.0) for n in range(40)], [(1, 45, 1.0)], [(1, 46, 1.0)]]
    found, _, _, out = run(spark, batches, [known])
    assert len(found) == 42
    sizes = {r["batch"]: r["count"] for r in spark.read.parquet(f"{out}/tested").groupBy("batch").count().collect()}
    assert sizes == {0: 40, 1: 1, 2: 1}
    assert spark.read.parquet(f"{out}/tested").where(F.size("reasons") == 0).count() == 0
