"""The stream queries lose no row: rows without a time, and a table without rows."""

import pytest
from oracle import compare, tables

from ringfold.operators import fanout
from ringfold.operators.fanout import _salted
from ringfold.operators.rules import rule_nodes
from ringfold.plans import catalog, shared
from ringfold.plans import views as v
from ringfold.plans.shared import FILE_ROWS, SLICES, event_files, event_slices, event_stream, slicing

QUERIES = [
    "stream_source", "event_sink", "stream_match", "stream_match_all", "stream_digest", "stateful_digest", "stream_job", "stream_restart",
    "event_sink_published", "stream_running_count", "stream_rule_changes",
    "count_window_digest",
]


@pytest.fixture(scope="module")
def odd_tables(spark, small_dir, tmp_path_factory):
    """The small tables, with a third of the events without a time, and with no events."""
    con = tables(small_dir)
    found = {}
    for kind, change in {"nulls": "* REPLACE (CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts END AS ts)", "none": "*"}.items():
        path = tmp_path_factory.mktemp(kind)
        for name in ("customer", "nation"):
            con.execute(f"COPY {name} TO '{path}/{name}.parquet'")
        where = "WHERE false" if kind == "none" else ""
        con.execute(f"COPY (SELECT {change} FROM events {where}) TO '{path}/events.parquet'")
        found[kind] = str(path)
    return found


@pytest.mark.parametrize("name", QUERIES)
def test_rows_without_a_time(spark, odd_tables, name):
    path = odd_tables["nulls"]
    assert compare(catalog.queries()[name](spark, path), tables(path), catalog.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", QUERIES)
def test_no_events(spark, odd_tables, name):
    assert catalog.queries()[name](spark, odd_tables["none"]).collect() == []


def test_files_are_in_order(spark, odd_tables):
    files = event_files(spark, odd_tables["nulls"])
    assert len(files) == SLICES
    parts = [spark.read.parquet(f).collect() for f in files]
    times = [(r.ts is not None, r.ts, r.event_id) for part in parts for r in sorted(part, key=lambda r: (r.ts is not None, r.ts, r.event_id))]
    assert times == sorted(times) and len({r.event_id for part in parts for r in part}) == len(times)


def test_micro_batches_grow_with_the_rules():
    # six times the driver's 1 GB: the index and the state are passed over for few micro-batches, each read by many tasks
    n_events, n_rules = 36_000_000, 5_400_000
    batches, width = slicing(n_events, n_rules)
    assert -(-n_events // batches) * 2 > n_rules and batches <= 7
    assert n_events / (batches * width) <= FILE_ROWS
    assert slicing(0, 0) == (SLICES, 1) and slicing(1000, 150) == (SLICES, 1)


@pytest.mark.parametrize("name", ["stream_match_all", "stream_restart", "stream_running_count", "stream_rule_changes"])
def test_micro_batches_of_several_files(spark, odd_tables, monkeypatch, name):
    monkeypatch.setattr(shared, "SLICE_ROWS", 100)
    monkeypatch.setattr(shared, "FILE_ROWS", 50)
    path = odd_tables["nulls"]
    assert event_slices(spark, path)[1] > 1
    assert compare(catalog.queries()[name](spark, path), tables(path), catalog.oracle_sql()[name]) is None


def test_a_large_index_is_copied_less_often_in_a_stream(spark, odd_tables, monkeypatch):
    asked = []

    def salted(probes, index, key, salts):
        asked.append(salts)
        return _salted(probes, index, key, salts)

    monkeypatch.setattr(fanout, "_salted", salted)
    monkeypatch.setattr(fanout, "default_salts", lambda df: 12)
    path = odd_tables["none"]
    records, rules = v.prepared(v.event_records(event_stream(spark, path))), v.subscriptions(spark, path)
    size = sum(fanout.node_profile(rule_nodes(rules)).values())
    for broadcast_bytes in (0, 1, size - 1):
        fanout.ring_range_join(records, rules, broadcast_bytes)
    assert asked[:2] == [1, 1] and 1 < asked[2] <= 12
