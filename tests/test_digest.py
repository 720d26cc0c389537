import pickle
import random

import pandas as pd
import pytest
from folds import counter, digests
from pyspark.sql import functions as F

from ringfold.functions.ring import keyed_hash
from ringfold.operators import digest as D
from ringfold.operators.fanout import PHASE_SEED, prepare_records
from ringfold.operators.folds import batch_fold, merge_fold, sorted_fold, window_fold
from ringfold.operators.rules import zipf_rules
from ringfold.plans.dataflow import digest_records
from ringfold.sources.records import generate_records

KEYS = ["a", "b", "c", "hot"]


def make_records(n=600, sizes=(8, 64), seed=5, same_ts=False):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.6 else rng.choice(KEYS)
        ms = 0 if same_ts else rng.randrange(0, 2000) * 10
        rows.append((key, ms, i, rng.randbytes(rng.randint(*sizes))))
    return rows


def matches_of(spark, rows, state_bytes, phased=False):
    df = spark.createDataFrame(rows, "rule_id string, ms bigint, record_id bigint, data binary")
    df = df.withColumn("ts", F.timestamp_millis("ms"))
    ids = df.select("rule_id", "record_id")
    return prepare_records(df, state_bytes, phased).join(ids, "record_id").drop("position")


def rows_of(df):
    columns = ("rule_id", "cycle", "n", "n_records", "total", "start_ms", "end_ms", "payload")
    rows = df.select(*columns).collect()
    return sorted(tuple(bytes(x) if isinstance(x, (bytes, bytearray)) else x for x in r) for r in rows)


@pytest.mark.parametrize("every, state_bytes", [(1, 40), (7, 32), (7, 48), (10, 128), (1000, 40)])
def test_digest_equals_fold(spark, every, state_bytes):
    rows = make_records()
    got = rows_of(D.count_window_digest(matches_of(spark, rows, state_bytes), every, state_bytes))
    assert got == digests(rows, every, state_bytes)


def phases_of(spark, rows, every):
    first = {}
    for key, _, record_id, data in sorted(rows, key=lambda r: (r[1], r[2])):
        first.setdefault(key, data[:32])
    df = spark.createDataFrame(list(first.items()), "k string, d binary")
    hashed = df.select("k", F.pmod(keyed_hash(F.col("d"), PHASE_SEED), F.lit(every)).alias("p"))
    return {r.k: r.p for r in hashed.collect()}


@pytest.mark.parametrize("every", [1, 10])
def test_phased_digest_equals_fold(spark, every):
    rows = make_records()
    phases = phases_of(spark, rows, every)
    got = rows_of(D.count_window_digest(matches_of(spark, rows, 48, True), every, 48))
    assert got == digests(rows, every, 48, phases)
    for key, cycle, n, n_records, _, start, _, _ in got:
        if cycle == 0 and phases[key]:
            assert (n, n_records, start) == (every, every - phases[key], 0)


@pytest.mark.parametrize("phased, same_ts", [(False, False), (True, True)])
def test_hot_rules_are_split(spark, phased, same_ts):
    rows = make_records(same_ts=same_ts)
    matches = matches_of(spark, rows, 40, phased)
    split = D.split_hot_rules(matches, max_rows=60)
    parts = split.rows.groupBy("rule_id", "part").count().collect()
    assert len({r.part for r in parts if r.rule_id == "hot"}) > 3
    assert max(r["count"] for r in parts) <= 120
    plain = rows_of(D.count_window_digest(matches, 7, 40))
    assert rows_of(D.count_window_digest(split, 7, 40)) == plain
    assert plain == digests(rows, 7, 40, phases_of(spark, rows, 7) if phased else None)
    assert sorted(D.running_count_events(split, 9).select("rule_id", "n", "record_id").collect()) == counter(rows, 9)


def test_dataflow_splits_large_rules(spark):
    records = generate_records(spark, 2000, 40, "flow").withColumn("ts", F.timestamp_seconds(F.col("record_id") % 50))
    rules = zipf_rules(spark, 20, 3.0, 1.0)
    plain = rows_of(digest_records(records, rules, 6, 48, True))
    assert rows_of(digest_records(records, rules, 6, 48, True, max_rows=300)) == plain
    assert rows_of(digest_records(records, rules, 6, 48, True, max_rows=1999)) == plain


def test_no_hot_rules_no_split(spark):
    assert D.split_hot_rules(matches_of(spark, make_records(50), 32), max_rows=1000) is None


def test_running_count(spark):
    rows = make_records()
    events = D.running_count_events(matches_of(spark, rows, 32), 10)
    assert sorted(tuple(r) for r in events.select("rule_id", "n", "record_id").collect()) == counter(rows, 10)
    assert all(bytes(r.value) == r.n.to_bytes(8, "big") for r in events.collect())


def test_partitions_do_not_matter(spark):
    rows = make_records()
    matches = matches_of(spark, rows, 40)
    results = [rows_of(D.count_window_digest(matches.repartition(n), 5, 40)) for n in (1, 4, 13)]
    assert results[0] == results[1] == results[2]


def test_packed_digest_layout(spark):
    rows = make_records(200)
    packed = D.pack_digests(D.count_window_digest(matches_of(spark, rows, 40), 6, 40), 40).collect()
    want = [
        (k, b"".join(x.to_bytes(8, "big", signed=True) for x in (n, total, start, end)) + body)
        for k, _, n, _, total, start, end, body in digests(rows, 6, 40)
    ]
    assert sorted((r.key, bytes(r.value)) for r in packed) == sorted(want)


@pytest.mark.parametrize("every", [0, -1, 1 << 31])
def test_bad_output_rate(spark, every):
    with pytest.raises(ValueError):
        D.count_window_digest(matches_of(spark, make_records(5), 32), every)


def test_small_state_is_an_error(spark):
    with pytest.raises(ValueError):
        D.count_window_digest(matches_of(spark, make_records(5), 32), 10, 31)
    with pytest.raises(ValueError):
        D.running_count_events(matches_of(spark, make_records(5), 32), 10, 7)


def test_digest_plan_has_one_shuffle_and_no_python(spark):
    matches = spark.createDataFrame([], "rule_id string, record_id bigint, ts timestamp, first_long bigint")
    plan = D.count_window_digest(matches, 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan and "SortAggregate" not in plan


def ups_and_downs():
    """A fold whose state depends on order: the last value, the sum of rises so far, and the number of rows."""

    def fold(key, state, rows):
        out = []
        for record_id, x in zip(rows["record_id"], rows["first_long"]):
            first, last, rises, n = state or (x, x, 0, 0)
            rises += max(0, int(x) - int(last)) % 1000
            state = (int(first), int(x), rises, n + 1)
            out.append((key, int(record_id), rises, n + 1))
        return state, out

    def merge(a, b):
        return a[0], b[1], a[2] + b[2] + max(0, b[0] - a[1]) % 1000, a[3] + b[3]

    return fold, merge


@pytest.mark.parametrize("same_ts", [False, True])
def test_merged_fold_equals_sequential_fold(spark, same_ts):
    fold, merge = ups_and_downs()
    rows = make_records(900, same_ts=same_ts)
    matches = matches_of(spark, rows, 32)
    schema = "rule_id string, record_id bigint, rises bigint, n bigint"
    want = sorted(batch_fold(matches, fold, schema).collect())
    # "hot" has more than half of the rows, the others are left whole or split too
    for most in (60, 200, 10_000):
        split = D.split_hot_rules(matches, most) or matches
        assert sorted(merge_fold(split, fold, merge, schema).collect()) == want
    hot = D.split_hot_rules(matches, 60)
    parts = hot.rows.where("rule_id = 'hot'").groupBy("part").count().collect()
    assert len(parts) > 8 and max(r["count"] for r in parts) < 120
    assert len(want) == 900


def test_merged_fold_with_nulls_and_more_columns(spark):
    def fold(key, state, rows):
        assert set(rows.columns) == {"rule_id", "record_id", "ts", "first_long", "extra", "kind"}
        assert str(rows["first_long"].dtype) == "int64"
        n = (state or (0,))[0]
        return (n + len(rows),), [(key, n + len(rows))]

    base = spark.range(100).selectExpr(
        "if(id % 2 = 0, 'a', 'b') AS rule_id", "id AS record_id", "if(id % 3 = 0, null, timestamp_seconds(id)) AS ts",
        "id AS first_long", "if(id % 5 = 0, null, 'x') AS extra", "array(id) AS kind",
    )
    split = D.split_hot_rules(base, 10)
    got = merge_fold(split, fold, lambda a, b: (a[0] + b[0],), "rule_id string, n bigint").groupBy("rule_id").agg(F.max("n").alias("n"))
    assert sorted(got.collect()) == [("a", 50), ("b", 50)]
    assert merge_fold(base.limit(0), fold, None, "rule_id string, n bigint").collect() == []


class Captured:
    """Stands for a sorted table: keeps the function that would run in its tasks."""

    def repartition(self, *keys):
        return self

    sortWithinPartitions = repartition

    def mapInPandas(self, run, schema):
        return run


def test_columns_are_dropped_per_batch_not_per_rule(monkeypatch):
    rules = [f"r{i:04}" for i in range(500)]
    batch = pd.DataFrame({"rule_id": rules * 2, "n": range(1000), "part": 0, "_state": None}).sort_values(["rule_id", "n"])
    batch.loc[batch["n"] == 7, "_state"] = [pickle.dumps((100,))]
    dropped = []
    drop = pd.DataFrame.drop
    monkeypatch.setattr(pd.DataFrame, "drop", lambda self, *args, **options: dropped.append(1) or drop(self, *args, **options))

    def fold(key, state, rows):
        assert "_state" not in rows
        total = (state or (0,))[0] + int(rows["n"].sum())
        return (total,), [(key, total)]

    run = sorted_fold(Captured(), ["rule_id", "part"], ["n"], fold, "rule_id string, total bigint", named=1)
    got = dict(pd.concat(run(iter([batch])))[["rule_id", "total"]].itertuples(index=False))
    assert got == {r: 2 * i + 500 if i != 7 else 607 for i, r in enumerate(rules)}
    assert len(dropped) <= 2


def test_window_fold_moves_only_what_the_fold_reads(spark):
    matches = matches_of(spark, make_records(200), 32)

    def fold(key, state, rows):
        assert list(rows.columns) == ["first_long"]
        n, total = state or (0, 0)
        state = (n + len(rows), total + int(rows["first_long"].sum()) % 1000)
        return state, [(key[0], int(key[1]), state[0])] if state[0] == 7 else []

    schema = "rule_id string, cycle bigint, n bigint"
    got = window_fold(matches, 7, fold, schema, ["first_long"])
    want = D.count_window_digest(matches, 7).select("rule_id", "cycle", "n")
    assert sorted(got.collect()) == sorted(want.collect())
