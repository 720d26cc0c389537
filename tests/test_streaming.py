import os

import pytest
from folds import digests
from pyspark.sql import functions as F
from test_digest import make_records, matches_of, phases_of, rows_of

from ringfold.operators.digest import count_window_digest, pack_digests
from ringfold.operators.folds import batch_fold, window_fold
from ringfold.operators.fanout import match_records, prepare_records
from ringfold.operators.rules import zipf_rules
from ringfold.plans.dataflow import digest_records
from ringfold.sources import streams as S
from ringfold.sources.records import paced_stream
from ringfold.streaming.digest import DigestSink, start_digest_stream
from ringfold.streaming.job import start_job
from ringfold.streaming.match import stream_match
from ringfold.streaming.state import stateful_digest, stateful_fold, use_state_store
from ringfold.workdir import work_dir

SCHEMA = "rule_id string, ms bigint, record_id bigint, data binary, ts timestamp"


def in_time_order(rows):
    """Renumber so that file order, time order and record order agree."""
    rows = sorted(rows, key=lambda r: (r[1], r[2]))
    return [(k, ms, i, data) for i, (k, ms, _, data) in enumerate(rows)]


def write_files(spark, rows, n, path):
    """Rows in ``n`` files, in time order, with increasing modification times."""
    size = -(-len(rows) // n)
    os.makedirs(path, exist_ok=True)
    for i in range(n):
        add_file(spark, rows[i * size : (i + 1) * size], path, i)


def add_file(spark, rows, path, number):
    frame = spark.createDataFrame(rows, "rule_id string, ms bigint, record_id bigint, data binary")
    pdf = frame.withColumn("ts", F.timestamp_millis("ms")).toPandas()
    pdf["ts"] = pdf["ts"].dt.tz_localize("UTC").astype("datetime64[us, UTC]")
    name = f"{path}/part-{number:03d}.parquet"
    pdf.to_parquet(name, index=False)
    os.utime(name, (1_700_000_000 + number, 1_700_000_000 + number))


def match_stream(spark, path, state_bytes, phased=False):
    """A match stream that keeps the rule each test row is made for."""
    schema = spark.createDataFrame([], SCHEMA).schema
    stream = S.file_records(spark, path, schema, max_per_trigger=1)
    # prepare_records drops rule_id, so it travels as part of the record's id
    tagged = stream.withColumn("record_id", F.struct("rule_id", "record_id"))
    prepared = prepare_records(tagged, state_bytes, phased).drop("position")
    return prepared.select("record_id.*", *[c for c in prepared.columns if c != "record_id"])


def run_sets(spark, source, out, every, state_bytes, phased=False, **options):
    stream = match_stream(spark, source, state_bytes, phased)
    query = start_digest_stream(stream, out, f"{out}/checkpoint", every, state_bytes, **options)
    query.awaitTermination()
    return query


def run_state(spark, source, out, every, state_bytes, phased=False):
    stream = match_stream(spark, source, state_bytes, phased)
    events = stateful_digest(stream, every, state_bytes, buckets=8, in_order=True)
    query = S.write_events(events, f"{out}/events", f"{out}/checkpoint")
    query.awaitTermination()
    return query


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


@pytest.mark.parametrize("run", [run_sets, run_state])
@pytest.mark.parametrize("files, phased", [(1, True), (2, False), (7, True)])
def test_stream_equals_batch(spark, folder, run, files, phased):
    rows = in_time_order(make_records(400))
    write_files(spark, rows, files, f"{folder}/in")
    run(spark, f"{folder}/in", folder, 7, 48, phased)
    got = rows_of(spark.read.parquet(f"{folder}/events"))
    assert got == digests(rows, 7, 48, phases_of(spark, rows, 7) if phased else None)
    assert got == rows_of(count_window_digest(matches_of(spark, rows, 48, phased), 7, 48))


@pytest.mark.parametrize("run", [run_sets, run_state])
def test_restart_continues(spark, folder, run):
    rows = in_time_order(make_records(300))
    thirds = [rows[:90], rows[90:200], rows[200:]]
    os.makedirs(f"{folder}/in")
    for i, part in enumerate(thirds):
        add_file(spark, part, f"{folder}/in", i)
        run(spark, f"{folder}/in", folder, 6, 40)
    run(spark, f"{folder}/in", folder, 6, 40)
    assert rows_of(spark.read.parquet(f"{folder}/events")) == digests(rows, 6, 40)


def test_replayed_batch_leaves_the_same_rows(spark, folder):
    rows = in_time_order(make_records(300))
    write_files(spark, rows, 3, f"{folder}/in")
    run_sets(spark, f"{folder}/in", folder, 6, 32)
    # forget that the last batch was finished, as after a crash before its commit
    os.replace(f"{folder}/checkpoint/commits/2", f"{folder}/lost-commit")
    crc = f"{folder}/checkpoint/commits/.2.crc"
    if os.path.exists(crc):
        os.replace(crc, f"{folder}/lost-crc")
    run_sets(spark, f"{folder}/in", folder, 6, 32)
    assert rows_of(spark.read.parquet(f"{folder}/events")) == digests(rows, 6, 32)


def test_hot_rule_in_a_stream_is_split(spark, folder):
    rows = in_time_order(make_records(400))
    write_files(spark, rows, 2, f"{folder}/in")
    run_sets(spark, f"{folder}/in", folder, 7, 40, True, max_rows=50)
    assert rows_of(spark.read.parquet(f"{folder}/events")) == digests(rows, 7, 40, phases_of(spark, rows, 7))


@pytest.mark.parametrize("engine", ["tables", "state_store"])
def test_restart_under_other_partitions(spark, folder, engine):
    """A job goes on where it stopped, whatever the number of shuffle partitions is now."""
    rows = in_time_order(make_records(300))
    rules = zipf_rules(spark, 30, 4.0, 1.0)
    schema = spark.createDataFrame([], SCHEMA).schema
    os.makedirs(f"{folder}/in")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    options = {"engine": engine, "in_order": True, "max_per_trigger": 1, "buckets": 16}
    try:
        for i, partitions in enumerate((4, 6, 3)):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            add_file(spark, rows[i * 100 : i * 100 + 100], f"{folder}/in", i)
            records = S.file_records(spark, f"{folder}/in", schema, max_per_trigger=1)
            start_job(records, rules, folder, 5, 48, **options).awaitTermination()
        for changed in ({"every": 6}, {"state_bytes": 64}, {"hash": "md5"}, {"random_phase": True}):
            with pytest.raises(ValueError, match="was kept with"):
                start_job(records, rules, folder, **({"every": 5, "state_bytes": 48} | options | changed))
        if engine == "state_store":
            with pytest.raises(ValueError, match="was kept with"):
                start_job(records, rules, folder, 5, 48, **(options | {"buckets": 32}))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = sorted((r.key, bytes(r.value)) for r in spark.read.parquet(f"{folder}/events").collect())
    want = pack_digests(digest_records(spark.read.parquet(f"{folder}/in"), rules, 5, 48), 48)
    assert got == sorted((r.key, bytes(r.value)) for r in want.collect()) and got


def test_in_order_asks_for_a_cap(spark, folder):
    rules = zipf_rules(spark, 3, 1.0, 1.0)
    with pytest.raises(ValueError, match="max_per_trigger"):
        start_job(spark.readStream.format("rate").load(), rules, folder, engine="state_store", in_order=True)


def test_stream_matches_all_kinds(spark, folder):
    rows = in_time_order(make_records(200))
    write_files(spark, rows, 3, f"{folder}/in")
    rules = zipf_rules(spark, 20, 2.0, 1.0)
    scanned = spark.createDataFrame([(f"scan_{i}", i) for i in range(5)], "rule_id string, digit int")
    kinds = {
        "scanned": (scanned, lambda record, rule: F.pmod(record("first_long"), F.lit(5)) == rule["digit"]),
        "predicates": {"late": lambda record: F.pmod(F.unix_millis(record("ts")), F.lit(2)) == 0},
    }
    schema = spark.createDataFrame([], SCHEMA).schema
    source = S.file_records(spark, f"{folder}/in", schema, max_per_trigger=1)
    S.write_events(stream_match(prepare_records(source), rules, **kinds), f"{folder}/events", f"{folder}/checkpoint").awaitTermination()
    batch = match_records(prepare_records(spark.read.parquet(f"{folder}/in")), rules, **kinds)
    pair = ["rule_id", "record_id"]
    got = sorted(spark.read.parquet(f"{folder}/events").select(*pair).collect())
    assert got == sorted(batch.select(*pair).collect()) and len({r.rule_id for r in got}) > 6


def test_foreign_state_is_refused(spark, folder):
    rows = in_time_order(make_records(60))
    write_files(spark, rows, 1, f"{folder}/in")
    run_sets(spark, f"{folder}/in", folder, 6, 32)
    with pytest.raises(ValueError, match="not 2"):
        DigestSink(folder, 6)._state(spark.range(1), 3)


@pytest.mark.parametrize("store", ["rocksdb", "in_memory"])
def test_state_stores_agree(spark, folder, store):
    rows = in_time_order(make_records(200))
    write_files(spark, rows, 2, f"{folder}/in")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    use_state_store(spark, store)
    try:
        run_state(spark, f"{folder}/in", folder, 5, 32)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert rows_of(spark.read.parquet(f"{folder}/events")) == digests(rows, 5, 32)


def test_arrival_order_fills_the_same_windows(spark, folder):
    rows = in_time_order(make_records(300))
    write_files(spark, rows, 2, f"{folder}/in")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        events = stateful_digest(match_stream(spark, f"{folder}/in", 40), 7, 40, in_order=False, buckets=2)
        S.write_events(events, f"{folder}/events", f"{folder}/checkpoint").awaitTermination()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    got = [r[:4] for r in rows_of(spark.read.parquet(f"{folder}/events"))]
    assert got == [r[:4] for r in digests(rows, 7, 40)]


def test_unknown_state_store(spark):
    with pytest.raises(ValueError):
        use_state_store(spark, "disk")


def test_batch_cap_and_counts(spark, folder):
    rows = in_time_order(make_records(100))
    write_files(spark, rows, 5, f"{folder}/in")
    query = run_sets(spark, f"{folder}/in", folder, 5, 32)
    sizes = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    assert sizes and len(os.listdir(f"{folder}/checkpoint/commits")) >= 5
    assert max(sizes) <= 40


def test_stream_match_equals_batch_match(spark, folder):
    rows = in_time_order(make_records(200))
    write_files(spark, rows, 2, f"{folder}/in")
    rules = zipf_rules(spark, 40, 3.0, 1.0)
    schema = spark.createDataFrame([], SCHEMA).schema
    stream = stream_match(prepare_records(S.file_records(spark, f"{folder}/in", schema)), rules)
    S.write_events(stream, f"{folder}/events", f"{folder}/checkpoint").awaitTermination()
    batch = match_records(prepare_records(spark.read.parquet(f"{folder}/in")), rules)
    pair = ["rule_id", "record_id"]
    got = sorted(spark.read.parquet(f"{folder}/events").select(*pair).collect())
    assert got == sorted(batch.select(*pair).collect()) and got


def totals():
    def fold(key, state, rows):
        total = (state[0] if state else 0) + int(rows["record_id"].sum())
        return (total,), [(key, total)]

    return fold


def test_custom_stateful_fold(spark, folder):
    rows = in_time_order(make_records(100))
    write_files(spark, rows, 2, f"{folder}/in")
    stream = match_stream(spark, f"{folder}/in", 32)
    out = stateful_fold(stream, totals(), "rule_id string, total bigint", "total bigint")
    S.write_events(out, f"{folder}/events", f"{folder}/checkpoint").awaitTermination()
    last = spark.read.parquet(f"{folder}/events").groupBy("rule_id").agg(F.max("total").alias("t")).collect()
    want = {}
    for key, _, record_id, _ in rows:
        want[key] = want.get(key, 0) + record_id
    assert {r.rule_id: r.t for r in last} == want


def test_batch_fold_carries_state_over_arrow_batches(spark):
    rows = make_records(300)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        sums = batch_fold(matches_of(spark, rows, 32), totals(), "rule_id string, total bigint")
        got = {r.rule_id: r.t for r in sums.groupBy("rule_id").agg(F.max("total").alias("t")).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {}
    for key, _, record_id, _ in rows:
        want[key] = want.get(key, 0) + record_id
    assert got == want


def counts():
    def fold(key, state, rows):
        n = (state[0] if state else 0) + len(rows)
        return (n,), [(key[0], int(key[1]), n)] if n == 7 else []

    return fold


def test_window_fold_sees_full_windows(spark):
    rows = make_records(300)
    got = window_fold(matches_of(spark, rows, 32), 7, counts(), "rule_id string, cycle bigint, n bigint")
    want = [(k, c, 7) for k, c, *_ in digests(rows, 7, 32)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_paced_stream_runs(spark, folder):
    stream = paced_stream(spark, sources=2, per_second=50, size=24)
    query = S.write_events(stream, f"{folder}/events", f"{folder}/checkpoint", trigger={"processingTime": "0 seconds"})
    try:
        for _ in range(200):
            done = query.lastProgress
            if done and done["batchId"] >= 2:
                break
            query.awaitTermination(0.1)
    finally:
        query.stop()
    rows = spark.read.parquet(f"{folder}/events").where("batch_id = 1")
    assert rows.count() == 100 and rows.select("data").distinct().count() == 100
    assert rows.groupBy("source").count().count() == 2


def test_delivery_levels(spark, folder):
    df = spark.range(3)
    for delivery, n in (("exactly_once", 3), ("at_least_once", 6)):
        for _ in range(2):
            S.write_batch(df, f"{folder}/{delivery}", 4, delivery)
        assert spark.read.parquet(f"{folder}/{delivery}").count() == n
    with pytest.raises(ValueError):
        S.write_batch(df, f"{folder}/x", 0, "at_most_twice")


def test_kafka_options():
    assert S.kafka_options("h:1", "in") == {
        "kafka.bootstrap.servers": "h:1", "subscribe": "in", "startingOffsets": "latest"
    }
    full = S.kafka_options("h:1", "in", {"in": {"0": 5}}, 100, "read_committed")
    assert full["startingOffsets"] == '{"in": {"0": 5}}'
    assert full["maxOffsetsPerTrigger"] == "100" and full["kafka.isolation.level"] == "read_committed"
    for bad in ({"starting": "middle"}, {"max_per_trigger": 0}, {"isolation": "dirty"}):
        with pytest.raises(ValueError):
            S.kafka_options("h:1", "in", **bad)


def test_kafka_sink_options():
    options = S.kafka_sink_options("h:1", "out", "/c")
    assert options["topic"] == "out" and options["checkpointLocation"] == "/c" and options["kafka.acks"] == "all"
    assert S.kafka_sink_options("h:1", "out", "/c", "none")["kafka.acks"] == "0"
    with pytest.raises(ValueError):
        S.kafka_sink_options("h:1", "out", "/c", "exactly_once")


def test_records_of_messages(spark):
    rows = [(None, b"x", "t", p, o, 5) for p in (0, 1, 99) for o in (0, 1, 10**12)]
    schema = "key binary, value binary, topic string, partition int, offset bigint, s bigint"
    messages = spark.createDataFrame(rows, schema).withColumn("timestamp", F.timestamp_seconds("s"))
    records = S.record_columns(messages)
    assert records.columns == ["record_id", "ts", "data"]
    ids = [r.record_id for r in records.collect()]
    assert ids == sorted(set(ids)) and min(ids) == 0


@pytest.mark.parametrize("engine", ["tables", "state_store"])
def test_job_writes_packed_events(spark, folder, engine):
    rows = in_time_order(make_records(200))
    write_files(spark, rows, 2, f"{folder}/in")
    rules = zipf_rules(spark, 30, 4.0, 1.0)
    schema = spark.createDataFrame([], SCHEMA).schema
    records = S.file_records(spark, f"{folder}/in", schema, max_per_trigger=1)
    start_job(records, rules, folder, 5, 48, True, engine=engine, in_order=True, max_per_trigger=1).awaitTermination()
    got = sorted((r.key, bytes(r.value)) for r in spark.read.parquet(f"{folder}/events").collect())
    want = pack_digests(digest_records(spark.read.parquet(f"{folder}/in"), rules, 5, 48, True), 48)
    assert got == sorted((r.key, bytes(r.value)) for r in want.collect()) and got
    with pytest.raises(ValueError):
        start_job(records, rules, folder, engine="paper")


def test_file_options():
    assert S.file_options() == {"latestFirst": "false"}
    assert S.file_options("latest", 3, pattern="*.parquet", max_age="2d") == {
        "latestFirst": "true", "maxFilesPerTrigger": "3", "pathGlobFilter": "*.parquet", "maxFileAge": "2d"
    }
    assert S.file_options(max_bytes_per_trigger=9)["maxBytesPerTrigger"] == "9"
    for bad in ({"starting": "middle"}, {"max_per_trigger": 1, "max_bytes_per_trigger": 1}):
        with pytest.raises(ValueError):
            S.file_options(**bad)


def test_work_dir_is_fresh_and_in_the_named_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert work_dir(spark, "x") != work_dir(spark, "x")
    assert base is None or work_dir(spark, "x").startswith(base.rstrip("/"))
