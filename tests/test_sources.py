import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ringfold.sources import offsets as O
from ringfold.sources.records import generate_records, paced_records


@pytest.mark.parametrize("size", [1, 8, 16, 40, 1024])
def test_record_size(spark, size):
    rows = generate_records(spark, 50, size).collect()
    assert {len(r.data) for r in rows} == {size}


def test_records_follow_from_seed_and_source(spark):
    tables = [sorted(generate_records(spark, 200, 40, partitions=n).collect()) for n in (1, 4, 13)]
    assert tables[0] == tables[1] == tables[2]
    assert sorted(generate_records(spark, 200, 40, source=1).collect()) != tables[0]
    assert sorted(generate_records(spark, 200, 40, seed="other").collect()) != tables[0]
    assert len({bytes(r.data) for r in tables[0]}) == 200


def test_record_bytes_are_even(spark):
    data = b"".join(bytes(r.data) for r in generate_records(spark, 500, 1024).collect())
    ones = sum(bin(b).count("1") for b in data)
    n = 8 * len(data)
    assert abs(ones - n / 2) < 4 * (n / 4) ** 0.5


def test_pace(spark):
    rows = paced_records(spark, 9, 2, 3.0, 16).orderBy("record_id").select(
        "record_id", "source", F.unix_micros("ts").alias("us")
    ).collect()
    for r in rows:
        assert r.source == r.record_id % 2
        assert r.us == (r.record_id // 2 + 1) * 333_333_333 // 1000
    with pytest.raises(ValueError):
        paced_records(spark, 1, 0)


def log(spark, *entries):
    return spark.createDataFrame(list(enumerate(entries)), "batch_id bigint, json string")


def test_explode_and_latest(spark):
    entries = ['{"a":{"0":1,"1":2}}', '{"a":{"0":5,"1":2},"b":{"0":7}}', '{"a":{"1":9}}']
    rows = O.explode_offsets(log(spark, *entries))
    assert rows.count() == 6
    newest = {(r.topic, r.partition): (r.batch_id, r.offset) for r in O.latest_offsets(rows).collect()}
    assert newest == {("a", 0): (1, 5), ("a", 1): (2, 9), ("b", 0): (1, 7)}


def test_newest_is_by_number(spark):
    df = spark.createDataFrame([(9, '{"a":{"0":1}}'), (10, '{"a":{"0":2}}')], "batch_id bigint, json string")
    assert O.latest_offsets(O.explode_offsets(df)).first().offset == 2


@pytest.mark.parametrize("bad", ["[]", "7", "{", '{"a":[1]}', '{"a":5}', '{"a":{"0":"x"}}', '{"a":{"0":null}}'])
def test_illegal_offsets(spark, bad):
    with pytest.raises(PySparkException, match="illegal offset|MALFORMED|CAST_INVALID"):
        O.explode_offsets(log(spark, '{"a":{"0":1}}', bad)).collect()


def test_read_checkpoint_files(spark, tmp_path):
    base = str(tmp_path)
    os.makedirs(f"{base}/offsets")
    for name, text in {"9": '{"t":{"0":1}}', "10": '{"t":{"0":4,"1":2}}', "x": "no", ".11.crc": "no"}.items():
        with open(f"{base}/offsets/{name}", "w") as f:
            f.write(f"v1\n{{}}\n{text}\n")
    read = O.read_offset_log(spark, base)
    assert sorted(r.batch_id for r in read.collect()) == [9, 10]
    assert {(r.partition, r.offset) for r in O.latest_offsets(O.explode_offsets(read)).collect()} == {(0, 4), (1, 2)}
