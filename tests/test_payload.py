import random

import pytest
from folds import signed
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ringfold.functions.payload import (
    counter_pack,
    event_pack,
    event_unpack,
    leading_long,
    require_state_bytes,
    wrapping_sum,
)


def test_leading_long(spark):
    values = [0, 1, -1, 2**63 - 1, -(2**63), 123456789]
    data = [(v, v.to_bytes(8, "big", signed=True) + b"tail") for v in values]
    rows = spark.createDataFrame(data, "v bigint, data binary").select("v", leading_long(F.col("data")).alias("got"))
    assert all(r.v == r.got for r in rows.collect())


def test_short_record_is_an_error(spark):
    with pytest.raises(PySparkException, match="shorter than 8"):
        spark.createDataFrame([(b"1234567",)], "data binary").select(leading_long(F.col("data"))).collect()


@pytest.mark.parametrize("size", [32, 33, 40, 64])
def test_pack_layout_and_round_trip(spark, size):
    rows = [(10, -5, 0, 1_700_000_000_000, b"\x01\x02\xff"[: size - 32]), (2**63 - 1, -(2**63), 1, -1, b"")]
    df = spark.createDataFrame(rows, "n bigint, total bigint, start_ms bigint, end_ms bigint, payload binary")
    packed = df.select("*", event_pack(*[F.col(c) for c in df.columns], size).alias("value"))
    for r in packed.collect():
        want = b"".join(x.to_bytes(8, "big", signed=True) for x in (r.n, r.total, r.start_ms, r.end_ms))
        assert bytes(r.value) == (want + bytes(r.payload)).ljust(size, b"\0")
    fields = event_unpack(F.col("value"))
    back = packed.select("n", "end_ms", *[c.alias(f"u_{k}") for k, c in fields.items()]).collect()
    assert all(r.n == r.u_n and r.end_ms == r.u_end_ms for r in back)


def test_counter_bytes(spark):
    df = spark.createDataFrame([(1,), (2,)], "n bigint").select(counter_pack(F.col("n")).alias("v"))
    assert [bytes(r.v).hex() for r in df.collect()] == ["0000000000000001", "0000000000000002"]


def test_state_sizes():
    assert require_state_bytes(32) == 32
    for size, least in ((31, 32), (7, 8)):
        with pytest.raises(ValueError):
            require_state_bytes(size, least)


@pytest.mark.parametrize("bits", [16, 22, 32])
def test_wrapping_sum(spark, bits):
    rng = random.Random(7)
    rows = [(k, rng.choice([2**63 - 1, -(2**63), rng.getrandbits(64) - 2**63])) for k in range(5) for _ in range(999)]
    df = spark.createDataFrame(rows, "k int, x bigint").repartition(7)
    got = {r.k: r.t for r in df.groupBy("k").agg(wrapping_sum(F.col("x"), bits).alias("t")).collect()}
    assert got == {k: signed(sum(x for q, x in rows if q == k)) for k in range(5)}
