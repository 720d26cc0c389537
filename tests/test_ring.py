import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ringfold.functions.ring import MATCH_ALL, RING_MASK, arc_width, hash_sample, in_arc, ring_position
from ringfold.sources.records import generate_records

SEED = 0x62_7F_EB_EE_DF_C3_72_87


def z_score(hits, n, p):
    return (hits - n * p) / math.sqrt(n * p * (1 - p))


def test_arc_width(spark):
    ps = [0.0, 2.0**-63, 2.0**-40, 0.3, 1 - 2.0**-53, 1.0, 2.0]
    rows = spark.createDataFrame([(p,) for p in ps], "p double").select("p", arc_width(F.col("p")).alias("w")).collect()
    assert {r.p: r.w for r in rows} == {p: MATCH_ALL if p >= 1 else int(math.ldexp(p, 63)) for p in ps}


@pytest.mark.parametrize("p", [-0.1, float("nan")])
def test_bad_selectivity_is_an_error(spark, p):
    with pytest.raises(PySparkException, match="not negative"):
        spark.createDataFrame([(p,)], "p double").select(arc_width(F.col("p"))).collect()


def test_in_arc_wraps(spark):
    edge = [0, 1, 5, 1 << 62, RING_MASK - 1, RING_MASK]
    widths = [0, 1, 7, 1 << 61, RING_MASK, MATCH_ALL]
    cases = [(x, o, w) for x in edge for o in edge for w in widths]
    df = spark.createDataFrame(cases, "x bigint, o bigint, w bigint")
    for r in df.select("*", in_arc(F.col("x"), F.col("o"), F.col("w")).alias("hit")).collect():
        assert r.hit == (r.w < 0 or (r.x - r.o) % (1 << 63) < r.w), r


POINT = st.integers(0, RING_MASK)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(POINT, POINT, st.integers(0, RING_MASK)), min_size=50, max_size=200))
def test_in_arc_anywhere(spark, cases):
    df = spark.createDataFrame(cases, "x bigint, o bigint, w bigint")
    for r in df.select("*", in_arc(F.col("x"), F.col("o"), F.col("w")).alias("hit")).collect():
        assert r.hit == ((r.x - r.o) % (1 << 63) < r.w), r


def test_position_reads_sixteen_bytes_only(spark):
    df = spark.createDataFrame([(b"0123456789abcdefX",), (b"0123456789abcdefYZ",)], "data binary")
    for hash in ("xxhash64", "md5"):
        positions = {r[0] for r in df.select(ring_position(F.col("data"), hash)).collect()}
        assert len(positions) == 1 and 0 <= positions.pop() <= RING_MASK


def test_unknown_hash(spark):
    with pytest.raises(ValueError):
        ring_position(F.lit(b"x"), "sha0")


@pytest.mark.parametrize("hash", ["xxhash64", "md5"])
def test_hash_filter_rate(spark, hash):
    records = generate_records(spark, 10_000, 1024, "filter")
    hits = records.where(hash_sample(F.col("data"), SEED, 0.3, hash)).count()
    assert abs(z_score(hits, 10_000, 0.3)) < 4
    assert records.where(hash_sample(F.col("data"), SEED, 1.0, hash)).count() == 10_000
    assert records.where(hash_sample(F.col("data"), SEED, 0.0, hash)).count() == 0


@pytest.mark.parametrize("hash", ["xxhash64", "md5"])
def test_arc_filter_rate(spark, hash):
    records = generate_records(spark, 10_000, 1024, "arc")
    inside = in_arc(ring_position(F.col("data"), hash), F.lit(SEED), arc_width(F.lit(0.3)))
    assert abs(z_score(records.where(inside).count(), 10_000, 0.3)) < 4


def test_seeds_are_independent(spark):
    records = generate_records(spark, 10_000, 16, "two")
    both = records.where(hash_sample(F.col("data"), 1, 0.3) & hash_sample(F.col("data"), 2, 0.3)).count()
    assert abs(z_score(both, 10_000, 0.09)) < 4
