"""Chunking, retrieval, streaming and model queries."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Window
from pyspark.sql import functions as F

from bindings import base_sql as b
from bindings import tables as t
from bindings.answer_queries import ALERTS_SQL, REPORT_SQL
from bindings.registry import query
from bindings.series_queries import LABEL, LIBRARY_ROWS
from faregrid.functions.text import ACTION_WORDS, DEFAULT_LINES
from faregrid.models import boosted
from faregrid.operators import metrics, retrieval, splits
from faregrid.operators.features import main_features
from faregrid.operators.forecast import predictions_table
from faregrid.plans import revenue
from faregrid.plans.thresholds import attach
from faregrid.storage import fresh_path, staged
from faregrid.streaming import alerts
from faregrid.streaming import features as growing
from faregrid.streaming import series as streaming

P = t.PARAMS

_CHUNKS = """RECURSIVE docs AS (
      SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL
    ),
    numbered AS (
      SELECT doc_id, i, sum(length(lines[i])) OVER (PARTITION BY doc_id ORDER BY i) AS chars
      FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM docs)
    ),
    sums AS (
      SELECT doc_id, len(lines) AS n, list_prepend(CAST(0 AS HUGEINT), list(chars ORDER BY i)) AS cum
      FROM numbered JOIN docs USING (doc_id) GROUP BY doc_id, lines
    ),
    spans(doc_id, n, cum, chunk_no, first_line, stop_line) AS (
      SELECT doc_id, n, cum, 0, 0, coalesce(list_min(list_filter(range(1, n), lambda i: cum[i + 2] - cum[1] > 600)), n) FROM sums
      UNION ALL
      SELECT doc_id, n, cum, chunk_no + 1, s, coalesce(list_min(list_filter(range(stop + 1, n),
        lambda i: cum[i + 2] - cum[s + 1] > 600)), n)
      FROM (
        SELECT doc_id, n, cum, chunk_no, stop_line AS stop, coalesce(list_max(list_filter(range(first_line, stop_line),
          lambda k: cum[stop_line + 1] - cum[k + 1] >= 150)), first_line) AS s
        FROM spans WHERE stop_line < n
      )
    ),
    chunks AS (
      SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, CAST(first_line AS INTEGER) AS first_line,
        CAST(stop_line AS INTEGER) AS stop_line,
        array_to_string(lines[first_line + 1:stop_line], chr(10)) AS chunk_text
      FROM spans JOIN docs USING (doc_id)
    )"""


# What the cleaned chunks are trimmed of.
_BLANKS = """chr(9) || chr(10) || chr(11) || chr(12) || chr(13)
        || chr(28) || chr(29) || chr(30) || chr(31) || ' ' || chr(133) || chr(160) || chr(5760)
        || (SELECT string_agg(chr(CAST(c AS INTEGER)), '') FROM range(8192, 8203) r(c))
        || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288)"""


@query("t1_chunks", f"WITH {_CHUNKS} -- result\nSELECT * FROM chunks")
def t1(spark, sf):
    return retrieval.chunk_documents(t.read(spark, sf, "documents"), p=P)


@query("t2_clean_chunks", f"""WITH {_CHUNKS}, trimmed AS (
      SELECT doc_id, chunk_no, trim(replace(chunk_text, '```', ''), {_BLANKS}) AS chunk_text FROM chunks
    ) -- result
    SELECT * FROM trimmed WHERE length(chunk_text) >= 50""")
def t2(spark, sf):
    chunks = retrieval.chunk_documents(t.read(spark, sf, "documents"), p=P)
    return retrieval.clean_chunks(chunks, P).select("doc_id", "chunk_no", "chunk_text")


_TOP = """means AS (
      SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x
      FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY label, i
    ),
    asked AS (SELECT label AS query_id, list(x ORDER BY i) AS vector FROM means GROUP BY label),
    scored AS (
      SELECT CAST(query_id AS BIGINT) AS query_id, vec_id AS base_id,
        round(list_dot_product(vector, CAST(embedding AS DOUBLE[])), 9) AS similarity FROM asked, embeddings
    ),
    ranked AS (
      SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, base_id) AS INTEGER) AS rank
      FROM scored QUALIFY rank <= 3
    )"""


def _top(spark, sf):
    return retrieval.top_similar(t.read(spark, sf, "embeddings"), t.label_queries(spark, sf), P.retrieve_k)


@query("t3_top_similar", f"WITH {_TOP} -- result\nSELECT * FROM ranked", "similarity")
def t3(spark, sf):
    return _top(spark, sf)


@query("t4_repaired_vectors", """SELECT vec_id, kind, list_sum(list_transform(CASE WHEN kind = 0 THEN embedding
      ELSE list_transform(embedding, lambda x: CAST(0 AS FLOAT)) END, lambda x: CAST(x AS DOUBLE))) AS total
    FROM (SELECT *, CAST(label % 4 AS INTEGER) AS kind FROM embeddings) AS result""", "total")
def t4(spark, sf):
    kind = (F.col("label") % 4).cast("int")
    v = F.col("embedding")
    broken = (
        F.when(kind == 1, F.lit(None).cast("array<float>"))
        .when(kind == 2, F.slice(v, 1, 10))
        .when(kind == 3, F.transform(v, lambda x: F.lit(float("nan")).cast("float")))
        .otherwise(v)
    )
    rows = t.read(spark, sf, "embeddings").select("vec_id", kind.alias("kind"), broken.alias("embedding"))
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return retrieval.repair_vectors(rows, 64).select("vec_id", "kind", total.alias("total"))


_SPACE = "chr(9) || chr(10) || chr(13) || ' '"


_NUMBERED = f"""{_CHUNKS}, trimmed AS (
      SELECT doc_id, chunk_no, trim(replace(chunk_text, '```', ''), {_BLANKS}) AS chunk_text FROM chunks
    ), numbered_chunks AS (
      SELECT row_number() OVER (ORDER BY doc_id, chunk_no) - 1 AS base_id, chunk_text FROM trimmed WHERE length(chunk_text) >= 50
    )"""


# The vectors stand for the cleaned chunks in order: vector 0 for the first of all.
@query("t5_contexts", f"""WITH {_NUMBERED}, {_TOP} -- result
    SELECT query_id, trim('RELEVANT DOCUMENTATION:' || chr(10) || chr(10)
      || string_agg('[Source ' || rank || ']' || chr(10) || coalesce(chunk_text, ''), chr(10) || chr(10) ORDER BY rank), {_SPACE}) AS context
    FROM ranked LEFT JOIN numbered_chunks USING (base_id) GROUP BY query_id""")
def t5(spark, sf):
    chunks = retrieval.clean_chunks(retrieval.chunk_documents(t.read(spark, sf, "documents"), p=P), P)
    texts = retrieval.numbered_chunks(staged(chunks, "clean-chunks")).select(F.col("number").alias("base_id"), "chunk_text")
    return retrieval.assemble_context(_top(spark, sf).join(texts, "base_id", "left"))


_words = " OR ".join(f"contains(lower(x), '{w}')" for w in ACTION_WORDS)
_defaults = ", ".join(f"'{line}'" for line in DEFAULT_LINES)


@query("t6_action_lines", f"""WITH texts AS (
      SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text
        WHEN 1 THEN 'Part three, the recommended action:' || chr(10) || text
        ELSE replace(text, chr(10), chr(10) || '  Possible Solution: ') END AS text FROM conversations
    ), found AS (
      SELECT conv_id, turn, list_transform(list_filter(string_split(text, chr(10)), lambda x: {_words}),
        lambda x: trim(x, {_SPACE})) AS lines FROM texts
    ), filled AS (
      SELECT conv_id, turn, CASE WHEN len(lines) > 0 THEN lines ELSE [{_defaults}] END AS lines FROM found
    ) -- result
    SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS line_no, lines[i] AS line
    FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM filled)""")
def t6(spark, sf):
    return retrieval.extract_actions(t.investigations(spark, sf))


@query("x1_streaming_series", f"""WITH {b.CLEAN}, cells AS (
      SELECT cluster_id, CAST(epoch(time_bucket(INTERVAL 6 HOUR, pickup_datetime, TIMESTAMP '1970-01-01')) AS BIGINT) AS bin_start,
        count(VendorID) AS demand, sum(total_amount) AS revenue_total, avg(total_amount) AS avg_fare,
        avg(trip_distance) AS avg_distance, avg(trip_duration_minutes) AS avg_duration, min(pickup_datetime) AS first_pickup
      FROM cleaned GROUP BY 1, 2
    ) -- result
    SELECT * EXCLUDE (first_pickup), bin_start + 21600 AS bin_end, CAST(hour(first_pickup) AS INTEGER) AS hour,
      CAST(isodow(first_pickup) - 1 AS INTEGER) AS day_of_week, CAST(isodow(first_pickup) >= 6 AS INTEGER) AS is_weekend,
      CAST(hour(first_pickup) IN (7, 8, 9, 16, 17, 18, 19) AS INTEGER) AS is_rush_hour FROM cells""",
       "revenue_total avg_fare avg_distance avg_duration")
def x1(spark, sf):
    """The events arrive as four files, one a batch, the latest quarter first: most trips are late."""
    events = t.read(spark, sf, "events")
    path = fresh_path(spark, "stream-series")
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    edges = events.select(seconds.alias("s")).approxQuantile("s", [0.25, 0.5, 0.75], 0.01) or [0.0] * 3
    quarter = sum((seconds > e).cast("int") for e in edges)
    for number in (3, 2, 1, 0):
        events.where(quarter == number).coalesce(1).write.mode("append").parquet(f"{path}/in")
    arriving = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    streaming.start_additive(t.trips_from_events(arriving), f"{path}/out", f"{path}/state", P).awaitTermination()
    return streaming.added_cells(spark, f"{path}/out", P)


@query("x2_incremental_features", f"""WITH {b.FEATURES} -- result
    SELECT cluster_id, time_bin, demand, pos, ft_1, ft_5, prev_avg_fare, exp_avg FROM features""", "prev_avg_fare exp_avg")
def x2_features(spark, sf):
    """The series arrives as three files, the middle third last, so that some zones change their past."""
    rows = t.series(spark, sf)
    path = fresh_path(spark, "growing-series")
    edges = rows.approxQuantile("time_bin", [0.33, 0.66], 0.01) or [0.0] * 2
    third = sum((F.col("time_bin") > e).cast("int") for e in edges)
    for number in (0, 2, 1):
        rows.where(third == number).coalesce(1).write.mode("append").parquet(f"{path}/in")
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    growing.start_features(arriving, f"{path}/out", f"{path}/state", p=P, previous=["avg_fare"]).awaitTermination()
    found = growing.current_features(spark, f"{path}/out").dropna(subset=["ft_5"])
    return found.select("cluster_id", "time_bin", "demand", "pos", "ft_1", "ft_5", "prev_avg_fare", "exp_avg")


@query("x2_monitoring_per_trigger", REPORT_SQL, "total_impact")
def x2(spark, sf):
    schema = t.read(spark, sf, "events").schema
    arrivals = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    path = fresh_path(spark, "monitoring")

    def update(batch, batch_id):
        """Predictions from all trips that have arrived."""
        t.trips_from_events(batch).write.mode("overwrite").parquet(f"{path}/trips/batch={batch_id}")
        rows = staged(revenue.main_series(spark.read.parquet(f"{path}/trips"), P), "arrived-series")
        return staged(t.predictions_of(rows), "arrived-predictions")

    streaming.start_monitoring(arrivals, update, f"{path}/out", f"{path}/state", P, available_now=True).awaitTermination()
    return spark.read.parquet(f"{path}/out/batch=*/kind=report")


@query("n13_alerts_on_arrivals", ALERTS_SQL)
def n13_arrivals(spark, sf):
    """Cells arrive in three files, the first time with wrong revenue; later predictions are known from the second batch on."""
    rows = t.predictions(spark, sf)
    path = fresh_path(spark, "alerts")
    actual = rows.select("cluster_id", "time_bin", "revenue_total")
    edge = (actual.approxQuantile("time_bin", [0.5], 0.01) or [0.0])[0]
    wrong = actual.withColumn("revenue_total", F.col("revenue_total") * 3).where(F.col("cluster_id") % 2 == 0)
    for part in (wrong, actual.where(F.col("time_bin") > edge), actual.where(F.col("time_bin") <= edge)):
        part.coalesce(1).write.mode("append").parquet(f"{path}/in")
    intervals = metrics.add_uncertainty_flag(metrics.prediction_intervals(rows, "revenue_pred", ["cluster_id"], 0.9))
    known = staged(attach(rows, intervals.select("cluster_id", "relative_width"), ["cluster_id"]), "known")

    def current(batch_id):
        return known if batch_id else known.where(F.col("time_bin") <= edge)

    arriving = spark.readStream.schema(actual.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    alerts.start_alerts(arriving, current, f"{path}/out", f"{path}/state", P).awaitTermination()
    found = alerts.current_alerts(spark, f"{path}/out")
    return found.select("cluster_id", "time_bin", F.array_join("reasons", ",").alias("reasons"))


# Published settings, with the penalties' size per row; the validation slice ends the training.
DEMAND, REVENUE = boosted.DEMAND, boosted.REVENUE
_SPLIT = f"""{b.FEATURES}, placed AS (
      SELECT *, row_number() OVER (ORDER BY time_bin, cluster_id) - 1 AS i, count(*) OVER () AS n FROM features
    ), labelled AS (SELECT *, {LABEL} FROM placed)"""


def _labelled(spark, sf):
    rows = staged(main_features(t.series(spark, sf), P, previous=["avg_fare"]), "main-features")
    return staged(splits.global_split(rows, p=P), "labelled-features")


def _part(df, name):
    return df.where(F.col("split") == name)


@lru_cache(maxsize=4)
def _stacked(app, spark, sf):
    """Fitted models and the labelled rows, once per session and folder."""
    rows = _labelled(spark, sf)
    settings = (boosted.for_rows(p, _part(rows, "train").count()) for p in (DEMAND, REVENUE))
    return boosted.fit_stacked(rows.where("split <> 'test'"), *settings, F.col("split") == "validation"), rows


def _models(spark, sf):
    return _stacked(spark.sparkContext.applicationId, spark, sf)


def _errors(scored, actual, predicted, model, naive):
    """Per split: rows, trees, the model's errors and those of the naive forecast."""
    own = metrics.metrics(scored, actual, predicted, ["wmape", "mae", "rmse", "r2"], by=["split"])
    simple = metrics.metrics(scored.withColumn("naive", naive), actual, "naive", ["wmape", "rmse"], by=["split"])
    sizes = scored.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))
    simple = simple.withColumnsRenamed({"wmape": "naive_wmape", "rmse": "naive_rmse"})
    return own.join(simple, "split").join(sizes, "split").withColumn("n_trees", F.lit(boosted.tree_count(model)))


def _quality(errors, limit):
    """Whether the model beats the mean, and the naive forecast both in absolute and in squared errors, on each split."""
    return errors.select(
        "split",
        "n_rows",
        (F.col("r2") > 0).alias("better_than_mean"),
        ((F.col("rmse") < F.col("naive_rmse")) & (F.col("wmape") < F.col("naive_wmape"))).alias("better_than_naive"),
        F.col("n_trees").between(1, limit).alias("trees_within_limit"),
    )


_QUALITY = f"""WITH {_SPLIT} -- result
    SELECT split, count(*) AS n_rows, true AS better_than_mean, true AS better_than_naive, true AS trees_within_limit
    FROM labelled GROUP BY split"""


def _demand_errors(spark, sf):
    (demand, _), rows = _models(spark, sf)
    return _errors(boosted.score(demand, rows), "demand", "demand_pred", demand, F.col("exp_avg"))


def _revenue_errors(spark, sf):
    models, rows = _models(spark, sf)
    return _errors(boosted.score_stacked(models, rows), "revenue_total", "revenue_pred", models[1], F.col("exp_avg") * F.col("prev_avg_fare"))


@lru_cache(maxsize=4)
def _library_model(app, spark, sf):
    table = revenue.library_feature_table(t.library_cells(spark, sf), t.CENTRES, P)
    rows = staged(splits.zone_split(staged(table, "library-features"), "pickup_cluster", "pickup_bins", P), "library-split")
    fitted = rows.where("split <> 'test'").withColumn("held_out", F.col("split") == "validation")
    settings = boosted.for_rows(DEMAND, _part(rows, "train").count())
    return boosted.fit_regressor(fitted, boosted.LIBRARY_FEATURES, "demand", "demand_pred", settings, "held_out"), rows


def _library_errors(spark, sf):
    model, rows = _library_model(spark.sparkContext.applicationId, spark, sf)
    return _errors(boosted.score(model, rows), "demand", "demand_pred", model, F.col("exp_avg"))


@query("m1_demand_model", _QUALITY)
def m1(spark, sf):
    return _quality(_demand_errors(spark, sf), DEMAND.trees)


@query("m2_stacked_revenue_model", _QUALITY)
def m2(spark, sf):
    return _quality(_revenue_errors(spark, sf), REVENUE.trees)


@query("m3_library_demand_model", f"""WITH {LIBRARY_ROWS}, placed AS (
      SELECT *, row_number() OVER (PARTITION BY pickup_cluster ORDER BY pickup_bins) - 1 AS i,
        count(*) OVER (PARTITION BY pickup_cluster) AS n FROM library_rows
    ), labelled AS (SELECT *, {LABEL} FROM placed) -- result
    SELECT split, count(*) AS n_rows, true AS better_than_mean, true AS better_than_naive, true AS trees_within_limit
    FROM labelled GROUP BY split""")
def m3(spark, sf):
    return _quality(_library_errors(spark, sf), DEMAND.trees)


@query("m_model_errors")
def m_errors(spark, sf):
    """Figures of the three models per split. No SQL states what a training gives; tests hold them against the naive forecast."""
    tables = ((name, errors(spark, sf)) for name, errors in (("demand", _demand_errors), ("revenue", _revenue_errors), ("library", _library_errors)))
    first, *others = (df.select(F.lit(name).alias("model"), *df.columns) for name, df in tables)
    for df in others:
        first = first.unionByName(df)
    return first


# Two trees each for demand and revenue: (feature, threshold, missing goes left, value of left, value of right).
STUMPS = (
    ("exp_avg", 20.0, True, -4.5, 6.25),
    ("hour", 11.0, False, -1.5, 2.0),
    ("demand_pred", 31.5, True, -310.0, 420.0),
    ("is_rush_hour", 0.0, True, -25.0, 40.0),
)


def _fixed_model(spark, stumps, features, prediction, base):
    rows = []
    for tree, (feature, threshold, left, low, high) in enumerate(stumps):
        rows += [(tree, 0, feature, threshold, left, 0.0, 1.0), (tree, 1, None, 0.0, False, low, 0.0), (tree, 2, None, 0.0, False, high, 0.0)]
    return boosted.model_of(spark.createDataFrame(rows, boosted.NODES), features, prediction, base)


def _case(stump):
    feature, threshold, left, low, high = stump
    return f"CASE WHEN {feature} <= {threshold} THEN {low} WHEN {feature} IS NULL THEN {low if left else high} ELSE {high} END"


# Forecasts and costs of a given ensemble, so that every figure can be stated in SQL.
@query("m4_given_ensemble", f"""WITH {_SPLIT}, demands AS (
      SELECT *, CAST(24.0 + {_case(STUMPS[0])} + {_case(STUMPS[1])} AS DOUBLE) AS demand_pred FROM labelled WHERE split = 'test'
    ), revenues AS (SELECT *, CAST(900.0 + {_case(STUMPS[2])} + {_case(STUMPS[3])} AS DOUBLE) AS revenue_pred FROM demands) -- result
    SELECT cluster_id, time_bin, demand_pred, revenue_pred, revenue_pred / demand_pred AS avg_fare_pred, revenue_pred * 0.65 AS driver_costs,
      revenue_pred * 0.029 AS processing_fees, revenue_pred * 0.05 AS ops_costs, revenue_pred * 0.271 AS profit_pred FROM revenues""",
       "demand_pred revenue_pred avg_fare_pred driver_costs processing_fees ops_costs profit_pred")
def m4_given(spark, sf):
    rows = _part(_labelled(spark, sf), "test")
    first = _fixed_model(spark, STUMPS[:2], boosted.MAIN_FEATURES, "demand_pred", 24.0)
    second = _fixed_model(spark, STUMPS[2:], [*boosted.MAIN_FEATURES, "demand_pred"], "revenue_pred", 900.0)
    scored = predictions_table(boosted.score_stacked((first, second), rows), P)
    costs = ["avg_fare_pred", "driver_costs", "processing_fees", "ops_costs", "profit_pred"]
    return scored.select("cluster_id", "time_bin", "demand_pred", "revenue_pred", *costs)


# Whatever the model predicts, costs are fixed shares of it.
@query("m4_batch_scoring", f"""WITH {_SPLIT} -- result
    SELECT cluster_id, time_bin, demand, 0.65 AS driver_share, 0.029 AS processing_share, 0.05 AS ops_share, 0.271 AS margin_pred
    FROM labelled WHERE split = 'test'""", "driver_share processing_share ops_share margin_pred")
def m4(spark, sf):
    models, rows = _models(spark, sf)
    scored = predictions_table(boosted.score_stacked(models, _part(rows, "test")), P)
    share = lambda name: F.col(name) / F.col("revenue_pred")
    return scored.select(
        "cluster_id",
        "time_bin",
        "demand",
        share("driver_costs").alias("driver_share"),
        share("processing_fees").alias("processing_share"),
        share("ops_costs").alias("ops_share"),
        "margin_pred",
    )


# The monitoring cycle on the models' own predictions: what holds whatever they predict.
@query("m7_model_chain", f"""WITH {_SPLIT} -- result
    SELECT count(DISTINCT cluster_id) AS zones_monitored, true AS feed_within_limit, true AS actions_match_feed,
      true AS costs_add_up FROM labelled""")
def m7(spark, sf):
    models, rows = _models(spark, sf)
    predictions = staged(revenue.model_predictions(rows, models, P), "model-predictions")
    feed, actions, report = revenue.monitoring_tables(predictions, P)
    off = F.abs(F.col("revenue_pred") - F.col("total_costs") - F.col("profit_pred"))
    costs = predictions.agg((F.max(off) < 1e-6).alias("costs_add_up"))
    found = feed.agg((F.count(F.lit(1)) <= P.max_opportunities + P.max_inefficient).alias("feed_within_limit"))
    acted = F.col("actions_proposed") == F.least("anomalies_detected", F.lit(P.feed_size))
    own = report.select("zones_monitored", acted.alias("actions_match_feed"))
    return attach(attach(own, found), costs)


_NAMES = ", ".join(f"('{name}')" for name in boosted.MAIN_FEATURES)


@query("m5_feature_importance", f"SELECT feature, true AS in_range, 1.0 AS total FROM (VALUES {_NAMES}) AS result(feature)", "total")
def m5(spark, sf):
    (demand, _), _ = _models(spark, sf)
    total = F.sum("splits").over(Window.partitionBy())
    share = F.col("splits") / total
    return boosted.feature_importance(spark, demand, None).select(
        "feature", share.between(0, 1).alias("in_range"), F.sum(share).over(Window.partitionBy()).alias("total")
    )


@query("s8_model_persistence", f"WITH {_SPLIT} -- result\nSELECT cluster_id, time_bin, true AS same FROM labelled")
def s8(spark, sf):
    (demand, _), rows = _models(spark, sf)
    path = fresh_path(spark, "model")
    boosted.save_model(spark, demand, path)
    loaded, _ = boosted.load_model(spark, path)
    scored = boosted.score(loaded, rows).select("cluster_id", "time_bin", F.col("demand_pred").alias("loaded"))
    original = boosted.score(demand, rows).select("cluster_id", "time_bin", "demand_pred")
    both = scored.join(original, ["cluster_id", "time_bin"])
    return both.select("cluster_id", "time_bin", F.col("loaded").eqNullSafe(F.col("demand_pred")).alias("same"))
