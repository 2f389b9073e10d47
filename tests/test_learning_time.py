"""Features of the past only, chosen settings, scoring, and windows that span stream batches."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from haulwise.catalog.learning import CUTS, past_reliability, training_frame
from haulwise.operators import learning as ln
from haulwise.session import scratch_path
from haulwise.sources.model import Model
from haulwise.streaming import jobs as st


def test_later_deliveries_change_no_earlier_feature(spark, folder):
    plain, changed = Model(spark, folder), Model(spark, folder)
    cut = F.lit(CUTS[0]).cast("date")
    # after the cut every delivery is late
    changed.__dict__["shipments"] = plain.shipments.withColumn("eta", F.when(F.col("delivered_at") >= cut, F.date_sub("delivered_at", 1)).otherwise(F.col("eta")))
    both = []
    for m in (plain, changed):
        done = plain.shipments.filter(F.col("delivered_at").isNotNull())
        both.append(done.select("shipment_id", "created_at").join(past_reliability(m, done), "shipment_id"))
    old = [x.filter(F.col("created_at") <= cut).select("shipment_id", "past_reliability") for x in both]
    assert old[0].count() > 100 and old[0].exceptAll(old[1]).isEmpty()
    new = [x.filter(F.col("created_at") > cut).select("shipment_id", "past_reliability") for x in both]
    assert not new[0].exceptAll(new[1]).isEmpty()


def test_scaling_is_fitted_on_the_training_period(spark, folder):
    got = training_frame(Model(spark, folder)).groupBy("split").agg(F.min("order_value_scaled").alias("lo"), F.max("order_value_scaled").alias("hi")).collect()
    train = next(r for r in got if r.split == "train")
    assert (train.lo, train.hi) == (0.0, 1.0)


@pytest.fixture(scope="module")
def examples(spark):
    rng = random.Random(4)
    rows = []
    for i in range(900):
        x = rng.gauss(0, 1)
        rows.append((i, x, rng.gauss(0, 1), int(rng.random() < 1 / (1 + math.exp(-2 * x))), ("train", "validation", "test")[i % 3]))
    return spark.createDataFrame(rows, "id long, x double, noise double, label int, split string")


def auc(rows):
    pos, neg = ([r.p for r in rows if r.label == k] for k in (1, 0))
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


def test_batch_score_is_the_fitted_formula(examples):
    fitted = ln.train_classifier(examples.filter("split = 'train'"), ["x", "noise"], "label")
    w, b = fitted[1].coefficients, fitted[1].intercept
    assert w[0] > 1 > abs(w[1])
    for r in ln.batch_score(fitted, examples.filter("split = 'test'")).collect():
        assert abs(r.p - 1 / (1 + math.exp(-(w[0] * r.x + w[1] * r.noise + b)))) <= 0.5001e-4


def test_grid_search_scores_the_best_setting_on_the_test_split(examples):
    grid = [(0.01, 0.0), (5.0, 1.0), (0.01, 0.0)]
    got = ln.grid_search(examples, ["x", "noise"], "label", "split", grid).collect()
    assert [(r.reg, r.elastic) for r in got] == grid and [r.is_best for r in got] == [True, False, False]
    # so strong a penalty leaves one probability for all
    assert got[1].auc == 0.5 and got[1].test_auc is None and got[0].auc == got[2].auc > 0.8
    fitted = ln.train_classifier(examples.filter("split = 'train'"), ["x", "noise"], "label", 0.01)
    assert abs(got[0].test_auc - auc(ln.batch_score(fitted, examples.filter("split = 'test'")).collect())) < 1e-6


def test_open_windows_grow_over_batches(spark):
    at = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    events = spark.createDataFrame([(0, 7, at(9, 10)), (0, 7, at(10, 20)), (1, 7, at(10, 40)), (1, 8, at(11, 5)), (2, 8, at(11, 59))],
                                   "drop int, user_id long, ts timestamp")
    path = scratch_path(spark, "open-windows")
    st.landing_runs(spark, events, "open-windows", [F.col("drop") == k for k in range(3)], lambda s, c: st.upsert_windows(
        st.tumbling_rates(s, "user_id", "ts", "1 hour", "10 minutes"), path, c))
    got = {(r.user_id, r.window_start.hour): (r.n, r.closed) for r in st.current_windows(spark, path, ["user_id"], "10 MINUTES").collect()}
    assert got == {(7, 9): (1, True), (7, 10): (2, True), (8, 11): (2, False)}


def test_repeats_in_later_batches_and_at_other_times(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 9, m)
    alerts = spark.createDataFrame([(0, 1, 1, at(0)), (0, 2, 1, at(5)), (1, 1, 1, at(20)), (1, 3, 1, at(21)), (2, 1, 1, at(40)), (2, 3, 2, at(41))],
                                   "drop int, score_id long, threshold_id long, ts timestamp")
    path = scratch_path(spark, "repeats")
    st.landing_runs(spark, alerts, "repeats", [F.col("drop") == k for k in range(3)],
                    lambda s, c: st.run_to_files(st.stream_dedup_alerts(s, "ts", "1 hour"), path, c))
    got = [tuple(r) for r in spark.read.parquet(path).select("score_id", "threshold_id").collect()]
    assert sorted(got) == [(1, 1), (2, 1), (3, 1), (3, 2)]
