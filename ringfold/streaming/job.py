"""The whole dataflow on a stream: records and rules in, packed events out."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ringfold.functions.payload import DIGEST_BYTES
from ringfold.operators.digest import pack_digests
from ringfold.operators.fanout import PHASE_SEED, prepare_records
from ringfold.sources.streams import kafka_records, write_events, write_events_kafka
from ringfold.streaming.digest import start_digest_stream
from ringfold.streaming.match import stream_match
from ringfold.streaming.settings import keep_settings
from ringfold.streaming.state import BUCKETS, stateful_digest, use_state_store

ENGINES = ("tables", "state_store")


def start_job(
    records: DataFrame,
    rules: DataFrame | None,
    path: str,
    every: int = 10,
    state_bytes: int = DIGEST_BYTES,
    random_phase: bool = False,
    hash: str = "xxhash64",
    engine: str = "tables",
    state_store: str = "rocksdb",
    in_order: bool = False,
    max_per_trigger: int | None = None,
    buckets: int = BUCKETS,
    trigger: Mapping[str, object] | None = None,
    scanned: tuple[DataFrame, Callable] | None = None,
    predicates: Mapping[str, Callable] | None = None,
) -> StreamingQuery:
    """Match a record stream and write ``(key, value)`` events to ``path/events``.

    ``engine`` says where open windows are kept: in tables below ``path``, in the order of
    time within a micro-batch, or in Spark's state store, of the kind ``state_store``, in
    the order of arrival. There, ``in_order`` sorts a micro-batch and asks for
    ``max_per_trigger``, the cap that ``records`` were read with.

    Both go on from ``path/checkpoint`` after a restart, under whatever number of shuffle
    partitions. What the state depends on is kept below ``path``; a restart with other
    settings is refused.
    """
    if engine not in ENGINES:
        raise ValueError(f"engine must be one of {ENGINES}, not {engine!r}")
    if in_order and engine == "state_store" and max_per_trigger is None:
        raise ValueError("folding in order holds a micro-batch; read records with a cap and name it as max_per_trigger")
    prepared = prepare_records(records, state_bytes, random_phase, hash, keep_data=bool(scanned or predicates))
    matches = stream_match(prepared, rules, scanned, predicates)
    checkpoint = f"{path}/checkpoint"
    settings = {"hash": hash, "phase_seed": PHASE_SEED if random_phase else None}
    if engine == "tables":
        options = {"packed": True, "trigger": trigger, "settings": settings}
        return start_digest_stream(matches, path, checkpoint, every, state_bytes, **options)
    layout = {"engine": engine, "every": every, "state_bytes": state_bytes, "buckets": buckets, **settings}
    keep_settings(records.sparkSession, path, layout)
    use_state_store(records.sparkSession, state_store)
    events = pack_digests(stateful_digest(matches, every, state_bytes, buckets=buckets, in_order=in_order), state_bytes)
    return write_events(events, f"{path}/events", checkpoint, trigger=trigger)


def start_kafka_job(
    spark: SparkSession,
    servers: str,
    topic_in: str,
    topic_out: str,
    rules: DataFrame | None,
    path: str,
    every: int = 10,
    state_bytes: int = DIGEST_BYTES,
    random_phase: bool = False,
    hash: str = "xxhash64",
    state_store: str = "rocksdb",
    delivery: str = "at_least_once",
    in_order: bool = False,
    buckets: int = BUCKETS,
    trigger: Mapping[str, object] | None = None,
    scanned: tuple[DataFrame, Callable] | None = None,
    predicates: Mapping[str, Callable] | None = None,
    **source_options,
) -> StreamingQuery:
    """The same from topic to topic, with the state store; checkpoint and settings are below ``path``."""
    if in_order and "max_per_trigger" not in source_options:
        raise ValueError("folding in order holds a micro-batch; cap it by max_per_trigger")
    layout = {"engine": "state_store", "every": every, "state_bytes": state_bytes, "buckets": buckets, "hash": hash}
    keep_settings(spark, path, layout | {"phase_seed": PHASE_SEED if random_phase else None})
    use_state_store(spark, state_store)
    records = kafka_records(spark, servers, topic_in, **source_options)
    prepared = prepare_records(records, state_bytes, random_phase, hash, keep_data=bool(scanned or predicates))
    matches = stream_match(prepared, rules, scanned, predicates)
    events = pack_digests(stateful_digest(matches, every, state_bytes, buckets=buckets, in_order=in_order), state_bytes)
    options = {"delivery": delivery} | ({"trigger": trigger} if trigger else {})
    return write_events_kafka(events, servers, topic_out, f"{path}/checkpoint", **options)
