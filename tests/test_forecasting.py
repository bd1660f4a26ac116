"""Model jobs: structure, reproducibility, and agreement of the measures with plain aggregates."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, SF_TINY
from tallyline import jobs
from tallyline.forecasting import features, model
from tallyline.operators import demand_shape, ingest
from tallyline.operators.rollup import DAILY
from tallyline.plans.forecast import active_model
from tallyline.sources import messages, predictions, sample, storage
from tallyline.streaming import rollups

AS_OF = sample.AS_OF
SLOT = [*features.PAIR, *features.CALENDAR_KEYS]


@pytest.fixture(scope="module")
def events(spark):
    return sample.store_events(spark, SF_TINY).persist()


@pytest.fixture(scope="module")
def rows(events):
    return features.training_features(events, history="slot").persist()


@pytest.fixture(scope="module")
def trained(rows):
    return model.train(rows, num_trees=10)


def test_slot_features_explain_the_label(rows):
    off = F.abs(F.col("avg_demand") * F.col("transaction_count") - F.col("total_demand"))
    assert rows.where(off > 1e-9).count() == 0
    assert rows.count() == rows.select(*SLOT).distinct().count()


def test_weekday_history_is_the_same_in_training_and_scoring(events):
    train = features.training_features(events)
    score = features.score_features(events, AS_OF)
    keys = [*features.PAIR, "day_of_week"]
    joined = train.select(*keys, "avg_demand").distinct().join(
        score.select(*keys, F.col("avg_demand").alias("served")).distinct(), keys
    )
    assert joined.count() > 0
    assert joined.where("avg_demand <> served").count() == 0


def test_grid_has_every_pair_at_every_hour(events):
    grid = features.forecast_grid(events, AS_OF)
    pairs = events.select(*features.PAIR).distinct().count()
    assert grid.count() == pairs * 168
    assert grid.distinct().count() == pairs * 168
    days = grid.agg(F.min("forecast_date"), F.max("forecast_date")).first()
    assert (days[0], days[1]) == (dt.date(2024, 1, 31), dt.date(2024, 2, 6))
    wrong = "is_weekend <> if(weekday(forecast_date) >= 5, 1, 0) OR day_of_week <> weekday(forecast_date) + 1"
    assert grid.where(wrong).count() == 0


def test_pair_without_history_counts_as_one(spark):
    seen = spark.sql(
        "SELECT 'X' AS product_id, 1 AS store_id, 'RETURN' AS transaction_type, 5 AS quantity, "
        "TIMESTAMP'2024-01-01 00:00:00' AS event_time"
    )
    row = features.score_features(seen, AS_OF).select("avg_demand", "transaction_count").distinct()
    assert [tuple(r) for r in row.collect()] == [(1.0, 1)]


def test_split_does_not_depend_on_partitions(rows):
    part = model.in_training_part(*SLOT)
    one = rows.coalesce(1).where(part).select(*SLOT)
    many = rows.repartition(7).where(part).select(*SLOT)
    assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0
    share = one.count() / rows.count()
    assert 0.7 < share < 0.9


def test_measures_agree_with_plain_aggregates(rows, trained):
    held_out = rows.where(~model.in_training_part(*SLOT))
    error = F.col("prediction") - F.col("total_demand")
    row = (
        trained.model.transform(held_out)
        .agg(
            F.sqrt(F.avg(error * error)).alias("rmse"),
            F.avg(F.abs(error)).alias("mae"),
            (1 - F.sum(error * error) / (F.var_pop("total_demand") * F.count("*"))).alias("r2"),
        )
        .first()
    )
    assert row.rmse == pytest.approx(trained.rmse)
    assert row.mae == pytest.approx(trained.mae)
    assert row.r2 == pytest.approx(trained.r2_score)


def test_training_is_repeatable(rows, trained):
    again = model.train(rows, num_trees=10)
    assert again.rmse == pytest.approx(trained.rmse, rel=1e-6)
    assert again.training_samples == trained.training_samples


def test_prediction_rows(spark, events, trained):
    scored = model.predict(trained.model, features.score_features(events, AS_OF), "v", AS_OF).persist()
    assert 0 < scored.count() <= features.forecast_grid(events, AS_OF).count()
    assert scored.where("NOT (confidence_lower <= predicted_demand AND predicted_demand <= confidence_upper)").count() == 0
    assert scored.where("predicted_demand <= 0 OR seasonal_factor <> 1.0").count() == 0
    assert scored.select("prediction_id").distinct().count() == scored.count()
    again = model.predict(trained.model, features.score_features(events, AS_OF), "v", AS_OF)
    assert again.select("prediction_id").exceptAll(scored.select("prediction_id")).count() == 0
    scored.unpersist()


@pytest.mark.parametrize("month, factor", [("2024-12-10", 1.5), ("2024-07-10", 1.1), ("2024-03-10", 1.0)])
def test_seasonal_factor(events, trained, month, factor):
    grid = features.score_features(events.limit(5), dt.datetime.fromisoformat(month))
    scored = model.predict(trained.model, grid, "v", AS_OF)
    assert [r[0] for r in scored.select("seasonal_factor").distinct().collect()] == [factor]


def test_product_unknown_to_the_model_is_scored(spark, events, trained):
    stranger = events.limit(1).withColumn("product_id", F.lit("NEW"))
    scored = model.predict(trained.model, features.score_features(stranger, AS_OF), "v", AS_OF)
    assert scored.count() == 168


def test_products_are_numbers_for_any_count(rows):
    for part in (rows, rows.where("product_id < 'P03'")):
        fitted = model.train(part, num_trees=3)
        assert fitted.model.stages[-1].getMaxBins() == model.MAX_BINS
        assert math.isfinite(fitted.rmse)


def test_model_does_not_depend_on_shuffle_partitions(spark, rows):
    before, scores = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (2, 8):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            fitted = model.train(rows, num_trees=5)
            scores.append((round(fitted.rmse, 9), round(fitted.r2_score, 9)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert scores[0] == scores[1]


def test_later_events_change_no_score(spark, events):
    frame = events.limit(200)
    late = frame.withColumn("event_time", F.lit(AS_OF + dt.timedelta(hours=1)).cast("timestamp"))
    for make in (features.score_features, features.forecast_grid):
        alone, mixed = make(frame, AS_OF), make(frame.unionByName(late), AS_OF)
        assert alone.exceptAll(mixed).count() == 0 and mixed.exceptAll(alone).count() == 0


def test_features_without_the_label_score_worse(rows, trained):
    honest = model.train(rows, columns=model.CALENDAR_FEATURES, num_trees=10)
    assert honest.r2_score < trained.r2_score


def test_comparison_of_two_algorithms(rows):
    compared = model.compare_models(rows, "v", AS_OF, num_trees=3).collect()
    assert {json.loads(r.parameters)["algorithm"] for r in compared} == {"RandomForest", "GBT"}
    assert all(math.isfinite(r.rmse) and r.training_samples > 0 for r in compared)


def test_jobs_from_messages_to_imported_predictions(spark, tmp_path, events):
    root = str(tmp_path)
    messages.write_messages(ingest.encode(events), f"{root}/landing")
    jobs.ingest(messages.file_stream(spark, f"{root}/landing"), root)
    version = jobs.train(spark, root, AS_OF, num_trees=5)
    assert version == "20240131_000000"
    stored = storage.child_directories(spark, f"{root}/models")
    assert [name.rsplit("_", 1)[0] for name in stored] == ["demand_forecast_20240131_000000"]
    current = active_model(predictions.read_metrics(spark, f"{root}/model_metrics")).first()
    assert current.model_version == version
    for _ in range(2):
        jobs.predict_and_import(spark, root, AS_OF)
    table = predictions.read_predictions(spark, f"{root}/demand_predictions")
    files = predictions.read_prediction_files(spark, f"{root}/predictions")
    assert table.count() == files.count() > 0
    csv = predictions.read_predictions_csv(spark, f"{root}/predictions_csv/20240131_000000")
    assert csv.exceptAll(files.select(*csv.columns)).count() == 0
    assert jobs.expire(spark, root, AS_OF + dt.timedelta(days=75)) != []


def test_jobs_by_name(spark, tmp_path, events):
    root, landing = str(tmp_path / "tables"), str(tmp_path / "landing")
    for store in (1, 2):
        messages.write_messages(ingest.encode(events.where(F.col("store_id") == store)), landing)
        jobs.main(["ingest", "--root", root, "--landing", landing])
    before = rollups.read_rollup(spark, f"{root}/rollups", DAILY).collect()
    jobs.main(["compact", "--root", root])
    after = rollups.read_rollup(spark, f"{root}/rollups", DAILY).collect()
    assert sorted(before) == sorted(after)
    jobs.main(["expire", "--root", root, "--as-of", "2024-06-30"])
    assert not [d for d in storage.child_directories(spark, f"{root}/realtime") if "event_date" in d]
    with pytest.raises(SystemExit):
        jobs.main(["ingest", "--root", root])


def test_forecast_of_a_held_out_week(spark):
    """Trained before the cut-over, the forecast of the week after it is near what was sold then, with
    one week of history as with three."""
    after = sample.store_events(spark, SF_SMALL, start=sample.CUTOVER)
    sold = after.where("transaction_type = 'SALE'").agg(F.sum("quantity")).first()[0]
    for weeks in (1, 3):
        start = sample.CUTOVER - dt.timedelta(weeks=weeks)
        known = sample.store_events(spark, SF_SMALL, start=start, end=sample.CUTOVER)
        fitted = model.train(features.weekly_training_features(known), num_trees=10)
        grid = features.weekly_score_features(known, sample.CUTOVER)
        scored = fitted.model.transform(grid).agg(F.sum("prediction")).first()[0]
        days = (sample.AS_OF - sample.CUTOVER).days
        assert scored / days * 7 == pytest.approx(sold / days * 7, rel=0.25), weeks


def test_weekly_features_of_no_events_are_empty(events):
    nothing = events.where("false")
    assert features.weekly_training_features(nothing).count() == 0
    assert features.weekly_score_features(nothing, AS_OF).count() == 0


def test_prediction_follows_the_active_row(spark, tmp_path, rows, trained):
    root, table = str(tmp_path / "models"), str(tmp_path / "metrics")
    with pytest.raises(LookupError):
        model.load_active(model.metrics_row(spark, trained, "none", AS_OF, active=False), root)
    other = model.train(rows, num_trees=3)
    for i, (version, fitted) in enumerate({"old": trained, "new": other}.items()):
        model.save_model(fitted, root, version)
        at = AS_OF + dt.timedelta(days=i)
        predictions.record_metrics(model.metrics_row(spark, fitted, version, at), table)
    chosen = lambda: model.load_active(predictions.read_metrics(spark, table), root)
    assert chosen().version == "new" and chosen().model.stages[-1].getNumTrees == 3
    predictions.activate(spark, table, "old")
    assert chosen().version == "old" and chosen().model.stages[-1].getNumTrees == 10
    # Stored again, the active version is read as before until its new row is there.
    model.save_model(other, root, "old")
    assert chosen().model.stages[-1].getNumTrees == 10


# Demand shape


@pytest.mark.parametrize(
    "hour, factor",
    [(0, 0.2), (6, 0.2), (7, 1.0), (9, 1.5), (12, 1.5), (13, 1.3), (15, 1.0), (17, 1.7), (20, 1.7), (21, 1.2), (22, 1.2), (23, 1.0)],
)
def test_first_hour_range_counts(spark, hour, factor):
    frame = spark.sql(f"SELECT TIMESTAMP'2024-05-06 {hour:02d}:30:00' AS t")
    assert frame.select(demand_shape.hour_factor(F.col("t"))).first()[0] == factor
    assert frame.select(demand_shape.calendar_weight(F.col("t"))).first()[0] == factor


@pytest.mark.parametrize(
    "time, level",
    [
        ("2024-05-06 00:00:00", 1.0),
        ("2024-04-06 00:00:00", 0.995),
        ("2023-12-08 00:00:00", (1 - 5 * 0.005) * 0.85),
        ("2023-07-11 00:00:00", (1 - 10 * 0.005) * 0.90),
    ],
)
def test_price_level(spark, time, level):
    frame = spark.sql(f"SELECT TIMESTAMP'{time}' AS t")
    got = frame.select(demand_shape.price_adjustment(F.col("t"), dt.datetime(2024, 5, 6))).first()[0]
    assert got == pytest.approx(level)


def test_sample_follows_the_weights(spark):
    frame = spark.sql(
        "SELECT id, TIMESTAMP'2024-05-06 00:00:00' + make_interval(0,0,0,0, CAST(id % 24 AS INT)) AS event_time "
        "FROM range(240000)"
    )
    expected = frame.agg(F.sum(demand_shape.keep_probability(F.col("event_time")))).first()[0]
    assert demand_shape.weighted_sample(frame, "id").count() == pytest.approx(expected, rel=0.02)
    assert demand_shape.weighted_sample(frame).count() == pytest.approx(expected, rel=0.02)
    by_hash = demand_shape.weighted_sample(frame, "id")
    assert by_hash.exceptAll(demand_shape.weighted_sample(frame.repartition(5), "id")).count() == 0
