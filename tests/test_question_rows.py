"""Answer rows of tagged questions, held against plain Python on a few rows."""

import pytest

from faregrid.operators import question_rows, tagging

ROWS = "cluster_id int, time_bin long, hour int, day_of_week int, demand_pred double, revenue_pred double, profit_pred double, margin_pred double"


@pytest.fixture(scope="module")
def predictions(spark):
    rows = [
        (1, 10, 8, 0, 5.0, 50.0, 10.0, 0.2), (2, 10, 8, 0, 9.0, 40.0, 20.0, 0.5), (2, 11, 8, 0, 8.0, 30.0, 9.0, 0.3),
        (3, 11, 20, 4, 9.0, 90.0, 30.0, 0.3), (3, 12, 20, 4, None, None, None, None), (4, 12, 8, 0, 0.0, 0.0, 0.0, None),
    ]
    return spark.createDataFrame(rows, ROWS)


def tagged(spark, predictions, *texts):
    return tagging.tag_questions(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), predictions)


def test_comparison_by_the_first_two_numbers(spark, predictions):
    asked = tagged(spark, predictions, "Compare zone 1 versus zone 2", "compare 2 and 2", "compare 1 and 99", None, "")
    rows = {r["id"]: r for r in question_rows.compared_zones(asked, predictions).collect()}
    assert set(rows) == {0, 1}
    assert (rows[0]["zone_1"], rows[0]["zone_2"], rows[0]["periods_2"]) == (1, 2, 2)
    assert rows[0]["demand_diff_pct"] == pytest.approx((5.0 - 8.5) / 8.5 * 100)
    assert rows[1]["demand_diff_pct"] == rows[1]["revenue_diff_pct"] == 0.0


def test_zone_without_demand_is_no_base(spark, predictions):
    row = question_rows.compared_zones(tagged(spark, predictions, "compare 1 vs 4"), predictions).first()
    assert (row["per_trip_2"], row["demand_diff_pct"]) == (0.0, 0.0)


def test_peaks_of_slices(spark, predictions):
    asked = tagged(spark, predictions, "most rides at 8 am on monday", "most rides", "most rides at 3 am", "most rides on friday")
    rows = sorted(
        (r["id"], r["rank"], r["cluster_id"], r["demand_pred"], r["from_slice"], r["n_rows"], r["zones"])
        for r in question_rows.peak_rows(asked, predictions).na.fill({"rank": 0}).collect()
    )
    assert rows == [
        (0, 1, 2, 9.0, True, None, None), (0, 2, 1, 5.0, True, None, None),  # the winner's other row is no alternative
        (1, 1, 2, 9.0, True, None, None), (1, 2, 3, 9.0, True, None, None),  # a tie goes to the earlier bin
        (2, 0, None, None, False, 6, 4),
        (3, 1, 3, 9.0, True, None, None),  # too few rows for alternatives
    ]


def test_advice_is_the_same_for_every_question(spark, predictions):
    asked = tagged(spark, predictions, "which should we improve", "what to fix", "should we raise price")
    rows = [(r["id"], r["intent"], r["rank"], r["cluster_id"]) for r in question_rows.advised_zones(asked, predictions).collect()]
    assert sorted(rows) == [(0, "improvement", 1, 1), (1, "improvement", 1, 1), (2, "price_increase", 1, 2), (2, "price_increase", 2, 3)]


def test_general_parts(spark, predictions):
    asked = tagged(spark, predictions, "hello", "tell me about zone 2 at 8 pm", "profit on friday", "thoughts on zone 3 margin overall")
    rows = question_rows.general_rows(asked, predictions).collect()
    parts = sorted((r["id"], r["part"], r["rank"] or 0, r["cluster_id"]) for r in rows if r["part"] != "margin")
    assert parts == [(0, "overall", 0, None), (1, "zone", 0, 2), (3, "overall", 0, None), (3, "zone", 0, 3)]
    assert sorted((r["id"], r["rank"], r["cluster_id"]) for r in rows if r["part"] == "margin") == [
        (2, 1, 3), (3, 1, 2), (3, 2, 2), (3, 3, 3), (3, 4, 1)
    ]
    overall = next(r for r in rows if r["id"] == 0)
    assert (overall["n_rows"], overall["demand"]) == (6, pytest.approx(6.2))


def test_empty_predictions(spark, predictions):
    none = predictions.limit(0)
    asked = tagged(spark, none, "most rides", "compare 1 and 2", "improve it", "overall")
    assert question_rows.compared_zones(asked, none).count() == 0
    assert [(r["n_rows"], r["zones"]) for r in question_rows.peak_rows(asked, none).collect()] == [(0, 0)]
    assert question_rows.advised_zones(asked, none).count() == 0
    assert {r["part"] for r in question_rows.general_rows(asked, none).collect()} == {"overall"}
