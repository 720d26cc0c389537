import random

import pytest
from pyspark.sql import functions as F

from ringfold.operators import rates as R
from ringfold.operators import sketches as K

SCHEMA = "key string, us bigint, value bigint"


def timed(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_micros("us"))


def brute_rates(rows, length_s, step_s):
    length, step, found = length_s * 10**6, step_s * 10**6, {}
    for key in {r[0] for r in rows}:
        best = {}
        for k, us, value in rows:
            if k == key and us is not None and value is not None:
                best[us] = max(value, best.get(us, value))
        series = sorted(best.items())
        if not series:
            continue
        end = -(-series[0][0] // step) * step
        while end < series[-1][0] + length:
            inside = [x for x in series if end - length < x[0] <= end]
            if len(inside) > 1:
                increase = sum(b if b < a else b - a for (_, a), (_, b) in zip(inside, inside[1:]))
                found[key, end] = (len(inside), increase, increase / ((inside[-1][0] - inside[0][0]) / 10**6))
            end += step
    return found


@pytest.mark.parametrize("length_s, step_s", [(10, 10), (10, 5), (60, 5)])
def test_sliding_rate(spark, length_s, step_s):
    rng = random.Random(length_s + step_s)
    rows, value = [], {"a": 0, "b": 0, None: 0}
    for i in range(600):
        # most rows under one key, gaps longer than the look-back, counters that start over
        key = rng.choice(["a", "a", "a", "b", None])
        us = (i + 150 * (i > 300)) * 700_000 + rng.randrange(400_000)
        value[key] = 0 if rng.random() < 0.05 else value[key] + rng.randrange(50)
        rows.append((key, us // 1_000_000 * 1_000_000 if i % 4 == 0 else us, value[key]))
    rows += [("a", None, 5), ("a", 3_000_000, None), ("c", 7_000_000, 3)]
    found = R.sliding_rate(timed(spark, rows), ["key"], length_s, step_s, value="value").collect()
    got = {(r.key, r.end_us): (r.n_samples, r.increase, r.per_second) for r in found}
    assert len(got) == len(found)
    want = brute_rates(rows, length_s, step_s)
    assert got.keys() == want.keys()
    for at, (n, increase, per_second) in want.items():
        assert got[at][:2] == (n, increase)
        assert got[at][2] == pytest.approx(per_second)


def test_total_rate_and_bad_lengths(spark):
    rows = [(k, s * 1_000_000, s * g) for k, g in (("a", 2), ("b", 3)) for s in range(1, 21)]
    found = R.total_rate(R.sliding_rate(timed(spark, rows), ["key"], 10, 10, value="value"), [])
    assert {(r.counters, r.per_second) for r in found.collect()} == {(2, 5.0)}
    for length_s, step_s in ((5, 10), (10, 0), (10, 3)):
        with pytest.raises(ValueError):
            R.sliding_rate(timed(spark, rows), ["key"], length_s, step_s, value="value")


def test_empty_counters(spark):
    assert R.sliding_rate(timed(spark, []), ["key"], 10, 5, value="value").count() == 0


def sample_rows(n):
    rng = random.Random(n)
    return [("x" if rng.random() < 0.9 else None, rng.randrange(100) * 1_000_000, int(rng.paretovariate(0.7))) for _ in range(n)]


def share(values, value):
    return sum(v < value for v in values) / len(values), sum(v <= value for v in values) / len(values)


@pytest.mark.parametrize("length_s, every_s", [(20, None), (20, 10)])
def test_merged_sketches_keep_their_error(spark, length_s, every_s):
    rows = sample_rows(20_000)
    steps = K.step_sketches(timed(spark, rows), ["key"], 5, k=200, value="value")
    windows = K.window_sketches(steps, ["key"], length_s, 5, every_s, k=200)
    hop = (every_s or length_s) * 1_000_000
    for r in K.sketch_quantiles(windows, ["key"]).collect():
        values = [v for k, us, v in rows if k == r.key and r.start_us <= us < r.start_us + length_s * 1_000_000]
        assert r.start_us % hop == 0 and r.samples == len(values) and r.value in values
        below, up_to = share(values, r.value)
        assert below - 3 * K.rank_error(200) <= r.quantile <= up_to + 3 * K.rank_error(200)
    run = K.sketch_quantiles(K.run_sketches(windows if every_s is None else steps, ["key"], k=200), ["key"]).collect()
    assert len(run) == 2 * 21 and sum({r.key: r.samples for r in run}.values()) == len(rows)


def test_small_sketches_are_exact(spark):
    rows = [("x", 0, v) for v in range(100, 0, -1)] + [("x", 0, None), ("x", None, 7)]
    steps = K.step_sketches(timed(spark, rows), ["key"], 5, value="value")
    found = {(r.start_us, r.quantile): r.value for r in K.sketch_quantiles(steps, ["key"], (0.05, 0.5, 1.0)).collect()}
    assert found == {(0, 0.05): 5, (0, 0.5): 50, (0, 1.0): 100, (None, 0.05): 7, (None, 0.5): 7, (None, 1.0): 7}
    assert [r.samples for r in K.window_sketches(steps, ["key"], 10, 5).collect()] == [100]
    assert [r.samples for r in K.run_sketches(steps, ["key"]).collect()] == [101]


def test_ranks(spark):
    steps = K.step_sketches(timed(spark, [("x", 0, v) for v in (1, 2, 2, 3)]), ["key"], 5, value="value")
    counts = spark.createDataFrame([("x", 0, 1, 1), ("x", 0, 2, 2), ("x", 0, 3, 1)], "key string, start_us bigint, value bigint, n bigint")
    (r,) = K.ranks(K.sketch_quantiles(steps, ["key"], [0.5]), counts, ["key"]).collect()
    assert (r.value, r.below, r.up_to) == (2, 0.25, 0.75)


def test_bad_windows_and_empty_samples(spark):
    steps = K.step_sketches(timed(spark, []), ["key"], 5, value="value")
    assert K.sketch_quantiles(K.window_sketches(steps, ["key"], 10, 5), ["key"]).count() == 0
    for options in ((7, 5), (10, 5, 4), (10, 0)):
        with pytest.raises(ValueError):
            K.window_sketches(steps, ["key"], *options)
    with pytest.raises(ValueError):
        K.sketch_quantiles(steps, ["key"], [0.0])
