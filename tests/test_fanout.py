import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ringfold.functions.ring import RING_MASK, hash_sample
from ringfold.operators import fanout as O
from ringfold.operators.rules import frequency_rules, place_rules, zipf_rules
from ringfold.sources.records import generate_records
from test_rules import edge_arcs, rule_rows


@pytest.fixture(scope="module")
def records(spark):
    """Positions at and around the ends of the test arcs, and random ones; a third are equal."""
    rng = random.Random(3)
    near = {(x + d) & RING_MASK for _, o, w in edge_arcs() for x in (o, o + max(w, 0)) for d in (-1, 0, 1)}
    points = sorted(near) + [rng.getrandbits(63) for _ in range(500)]
    points += [points[40]] * (len(points) // 2)
    rows = [(i, x) for i, x in enumerate(points)]
    df = spark.createDataFrame(rows, "record_id bigint, position bigint")
    return df.withColumn("ts", F.timestamp_seconds("record_id"))


def brute(records, rules):
    return {
        (rule_id, r.record_id)
        for r in records.collect()
        for rule_id, offset, width in rules
        if width < 0 or (r.position - offset) % (1 << 63) < width
    }


@pytest.mark.parametrize("options", [{}, *({"broadcast_bytes": b} for b in (0, 700, 3000, 6000)), {"broadcast_bytes": 0, "salts": 5}])
def test_join_equals_brute_force(spark, records, options):
    arcs = edge_arcs()
    got = [(r.rule_id, r.record_id) for r in O.ring_range_join(records, rule_rows(spark, arcs), **options).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(records, arcs)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_join_plans(spark, records):
    rules = zipf_rules(spark, 2000, 1.0, 1.0)
    small = plan_of(O.ring_range_join(records, rules))
    assert "BroadcastHashJoin" in small
    assert "hashpartitioning(node" not in small
    large = plan_of(O.ring_range_join(records, rules, broadcast_bytes=0, salts=4))
    assert "salt" in large
    for plan in (small, large):
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


def test_payload_is_not_multiplied(spark):
    prepared = O.prepare_records(generate_records(spark, 10, 1024).withColumn("ts", F.timestamp_seconds(F.lit(0))))
    matches = O.match_records(prepared, zipf_rules(spark, 10, 5.0))
    assert matches.columns == ["rule_id", "record_id", "ts", "first_long"]


def test_no_rules_no_matches(spark, records):
    assert O.ring_range_join(records, rule_rows(spark, [])).count() == 0


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 700}, {"broadcast_bytes": 100}])
def test_scan_tests_every_pair(spark, options):
    records = generate_records(spark, 300, 24, "scan")
    rules = spark.range(20).select(F.col("id").cast("string").alias("rule_id"), "id", (F.col("id") / 20).alias("rate"))

    def sampled(record, rule):
        return hash_sample(record("data"), rule["id"], rule["rate"])

    found = O.scan_fanout(records, rules, sampled, **options)
    assert "NestedLoop" not in plan_of(found) and "Cartesian" not in plan_of(found)
    got = sorted((r.rule_id, r.record_id) for r in found.collect())
    want = []
    for i in range(20):
        kept = records.where(hash_sample(F.col("data"), F.lit(i).cast("bigint"), i / 20))
        want += [(str(i), r.record_id) for r in kept.collect()]
    assert got == sorted(want)


def test_predicates_and_vectorised_udf(spark):
    @F.pandas_udf("boolean")
    def odd(x: pd.Series) -> pd.Series:
        return x % 2 == 1

    records = spark.range(100).withColumnRenamed("id", "record_id")
    rules = {
        "odd": lambda record: odd(record("record_id")),
        "small": lambda record: record("record_id") < 10,
        "none": lambda record: F.lit(None).cast("boolean"),
    }
    got = sorted((r.rule_id, r.record_id) for r in O.predicate_fanout(records, rules).collect())
    assert got == sorted([("odd", i) for i in range(1, 100, 2)] + [("small", i) for i in range(10)])


def test_kinds_are_added_up(spark, records):
    rules = rule_rows(spark, edge_arcs())
    ring = O.ring_range_join(records, rules)
    others = {"all": lambda record: F.lit(True), "even": lambda record: record("record_id") % 2 == 0}
    want = sorted(ring.unionAll(O.predicate_fanout(records, others)).collect())
    one_pass = O.match_records(records, rules, predicates=others)
    assert "BroadcastHashJoin" in plan_of(one_pass) and "NestedLoop" not in plan_of(one_pass)
    assert plan_of(one_pass).count("Scan ExistingRDD") == plan_of(ring).count("Scan ExistingRDD")
    assert sorted(one_pass.collect()) == want
    assert sorted(O.match_records(records, rules, predicates=others, broadcast_bytes=0).collect()) == want
    with pytest.raises(ValueError):
        O.match_records(records)


def test_all_rules_hit_at_their_rate(spark):
    share = F.pow(F.lit(0.5), (F.col("id") % 9).cast("double"))
    numbers = spark.range(90).select(F.col("id").alias("rule_no"), share.alias("selectivity"))
    records = generate_records(spark, 100_000, 8, "rates").withColumn("ts", F.timestamp_seconds("record_id"))
    rules = place_rules(numbers)
    rates = O.rule_hit_rate(O.match_records(O.prepare_records(records), rules), records, rules).collect()
    assert len(rates) == 90
    for r in rates:
        if r.selectivity == 1:
            assert r.n_matches == 100_000 and r.z is None
        else:
            assert abs(r.z) < 4.5, r


def test_hit_rate_of_a_rule_without_matches(spark):
    records = generate_records(spark, 10, 8).withColumn("ts", F.timestamp_seconds("record_id"))
    rules = frequency_rules(spark, {0.0: 1})
    rate = O.rule_hit_rate(O.match_records(O.prepare_records(records), rules), records, rules).first()
    assert (rate.n_matches, rate.rate, rate.z) == (0, 0.0, None)


def test_million_rules_expected_matches(spark):
    records = generate_records(spark, 50_000, 16, "many").withColumn("ts", F.timestamp_seconds("record_id"))
    n = O.ring_range_join(O.prepare_records(records), zipf_rules(spark, 1_000_000, 0.2)).count()
    assert abs(n - 10_000) < 4 * math.sqrt(10_000)


def ring_brute(records, rules):
    """Matches in numpy, all pairs."""
    points = records.select("record_id", "position").toPandas()
    arcs = rules.select("rule_id", "offset", "width").toPandas()
    offset, width = arcs["offset"].to_numpy(), arcs["width"].to_numpy()
    out = []
    for r, x in zip(points["record_id"], points["position"]):
        hit = (width < 0) | (((x - offset) & RING_MASK) < width)
        out += [(i, r) for i in arcs["rule_id"][hit]]
    return sorted(out)


@pytest.mark.parametrize("s", [0.0, 1.0])
def test_many_rules_beyond_the_broadcast_size(spark, s):
    records = O.prepare_records(generate_records(spark, 400, 16, "hybrid").withColumn("ts", F.timestamp_seconds("record_id")))
    rules = zipf_rules(spark, 300_000, 20.0, s)
    joined = O.ring_range_join(records, rules, broadcast_bytes=6 << 20)
    assert sorted((r.rule_id, r.record_id) for r in joined.collect()) == ring_brute(records, rules)


def test_hybrid_plan_shuffles_records_once(spark):
    records = O.prepare_records(generate_records(spark, 400, 16, "hybrid").withColumn("ts", F.timestamp_seconds("record_id")))
    rules = zipf_rules(spark, 100_000, 20.0, 1.0)
    profile = O.node_profile(O.rule_nodes(rules))
    deepest = sorted(profile.values())[-2:]
    small = sum(profile.values()) - sum(deepest)
    assert len(profile) > 3
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # the index is small here, and would be broadcast after all
    try:
        plan = plan_of(O.ring_range_join(records, rules, broadcast_bytes=small + (1 << 20)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # two deep levels, one exchange of the look-ups, one of the index; coarse levels and the bitmap are broadcast
    assert plan.count("Exchange hashpartitioning(node") == 2, plan
    assert plan.count("BroadcastHashJoin") >= 2 and "bit_or" in plan and "Python" not in plan


def test_bitmap_drops_look_ups_before_the_shuffle(spark):
    records = spark.range(20_000).selectExpr("id AS record_id", "xxhash64(id) & 9223372036854775807 AS position")
    rules = zipf_rules(spark, 2_000, 0.0002)
    profile = O.node_profile(O.rule_nodes(rules))
    index = O._index(O.rule_nodes(rules))
    probes = O._probes(records, profile)
    kept = O._occupied(probes, index, sum(profile.values()) // O.ROW_BYTES, 1 << 20)
    assert probes.count() == 20_000 and kept.count() < 4_000
    assert kept.join(index, "node").count() == probes.join(index, "node").count()
    # without room for a bitmap all stay
    assert O._occupied(probes, index, 10_000, 100).count() == 20_000


def test_only_hot_segments_are_copied(spark):
    hot = 123 << 40
    position = F.when(F.col("id") % 2 == 0, F.lit(hot)).otherwise(F.xxhash64("id").bitwiseAND(F.lit(RING_MASK)))
    records = spark.range(40_000).select(F.col("id").alias("record_id"), position.alias("position"))
    arcs = [("at", hot, 5), ("wide", hot - 10, 1 << 40)] + [(f"r{i}", (i * 7919) << 36, 1 << 30) for i in range(3000)]
    rules = rule_rows(spark, arcs)
    index, probes = O._index(O.rule_nodes(rules)), O._probes(records, O.node_profile(O.rule_nodes(rules)))
    found = O.heavy_nodes(probes, 64)
    salts = {r.node: r.salts for r in found.collect()}
    # the segments that hold the hot position, one per level, and nothing else
    assert 1 <= len(salts) <= 4 and all(16 <= n <= 512 for n in salts.values())
    copied = index.join(found, "node", "left").selectExpr("coalesce(salts, 1) AS n").agg(F.sum("n")).first()[0]
    rows = {r.node: r["count"] for r in index.groupBy("node").count().collect()}
    assert copied == sum(n * salts.get(node, 1) for node, n in rows.items()) < sum(rows.values()) + 5 * 512
    got = sorted((r.rule_id, r.record_id) for r in O.ring_range_join(records, rules, broadcast_bytes=0).collect())
    assert got == sorted((r.rule_id, r.record_id) for r in O.ring_range_join(records, rules).collect())
    assert O.heavy_nodes(O._probes(records.where("record_id % 2 = 1"), [20]), 64) is None


def test_no_hot_segments_in_no_records(spark, records):
    assert O.heavy_nodes(O._probes(records.limit(0), [4, 8]), 8) is None
    assert O.ring_range_join(records.limit(0), rule_rows(spark, edge_arcs()), broadcast_bytes=0).count() == 0
