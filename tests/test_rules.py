import math

import pytest
from pyspark.sql import functions as F

from ringfold.functions.ring import MATCH_ALL, RING_MASK
from ringfold.operators import rules as R


def rule_rows(spark, rows):
    return spark.createDataFrame(rows, "rule_id string, offset bigint, width bigint")


def edge_arcs():
    offsets = [0, 1, 1 << 55, (1 << 55) - 1, (1 << 59), RING_MASK, RING_MASK - 5, 0x2E3FAC4F58FC98B4]
    widths = [0, 1, 2, 1 << 23, 1 << 51, (1 << 51) + 1, 1 << 55, 1 << 59, 1 << 60]
    widths += [(1 << 62) + 3, RING_MASK - 2, MATCH_ALL]
    return [(f"r{i}", o, w) for i, (o, w) in enumerate((o, w) for o in offsets for w in widths)]


def test_zipf_shares(spark):
    rules = R.zipf_rules(spark, 1000, 0.2, 1.0).collect()
    assert len({r.rule_id for r in rules}) == 1000
    harmonic = sum(1 / k for k in range(1, 1001))
    for r in rules:
        assert math.isclose(r.selectivity, 0.2 / (r.rule_no + 1) / harmonic, rel_tol=1e-9)
        assert 0 <= r.offset <= RING_MASK and r.width == int(math.ldexp(r.selectivity, 63))
    assert all(math.isclose(r.selectivity, 2e-4) for r in R.zipf_rules(spark, 1000, 0.2).collect())


def test_zipf_does_not_depend_on_partitions(spark):
    numbers = spark.range(5000).withColumnRenamed("id", "rule_no")
    tables = [
        sorted(R.place_rules(R.zipf_selectivities(numbers.repartition(n), 1.0, 0.7)).collect()) for n in (1, 4, 13)
    ]
    assert tables[0] == tables[1] == tables[2]


def test_frequency_rules(spark):
    rules = R.frequency_rules(spark, {0.1: 5, 0.5: 3, 0.01: 20, 0.3: 0}).orderBy("rule_no").collect()
    assert [r.rule_no for r in rules] == list(range(28))
    assert [r.selectivity for r in rules] == [0.5] * 3 + [0.1] * 5 + [0.01] * 20
    assert rules[7].rule_id == "consumer_7"


def test_frequency_rules_of_a_long_spec(spark, monkeypatch):
    spec = spark.range(300).select((F.lit(1.0) / (F.col("id") + 1)).alias("selectivity"), (F.col("id") % 4).alias("n"))
    plain = R.frequency_numbers(spec).orderBy("rule_no").collect()
    monkeypatch.setattr(R, "SMALL_SPEC", 10)
    monkeypatch.setattr(R, "COUNT_CHUNK", 2)
    monkeypatch.setattr(R, "RULES_PER_TASK", 100)
    assert R.frequency_numbers(spec).orderBy("rule_no").collect() == plain
    assert len(plain) == 450 and [r.rule_no for r in plain] == list(range(450))


def test_upsert_replaces(spark):
    old = rule_rows(spark, [("a", 1, 1), ("b", 2, 2)])
    new = rule_rows(spark, [("b", 9, 9), ("c", 3, 3)])
    assert sorted(tuple(r) for r in R.upsert_rules(old, new).collect()) == [("a", 1, 1), ("b", 9, 9), ("c", 3, 3)]


def test_remove_reports(spark):
    rules = rule_rows(spark, [("1", 1, 1 << 62)])
    ids = spark.createDataFrame([("1",)], "rule_id string")
    none = rules.where("false")
    assert [r.found for r in R.removal_report(none, ids).collect()] == [False]
    assert [r.found for r in R.removal_report(rules, ids).collect()] == [True]
    left = R.remove_rules(rules, ids)
    assert left.count() == 0
    assert [r.found for r in R.removal_report(left, ids).collect()] == [False]


@pytest.mark.parametrize("bits", [1, 8, 12])
def test_slots_are_exact(spark, bits):
    arcs = [a for a in edge_arcs()]
    shift = 63 - bits
    want = set()
    for rule_id, offset, width in arcs:
        if width < 0:
            touched = range(1 << bits)
        elif width == 0:
            touched = []
        else:
            first, last = offset >> shift, (offset + width - 1) >> shift
            touched = range(first, min(last, first + (1 << bits) - 1) + 1)
        want |= {(s % (1 << bits), rule_id) for s in touched}
    got = [tuple(r) for r in R.rule_slots(rule_rows(spark, arcs), bits).select("slot", "rule_id").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_at_most_two_nodes_per_rule(spark):
    nodes = R.rule_nodes(rule_rows(spark, edge_arcs())).collect()
    per_rule = {}
    for n in nodes:
        per_rule.setdefault(n.rule_id, []).append(n)
    for rule_id, offset, width in edge_arcs():
        mine = per_rule.get(rule_id, [])
        assert len(mine) <= 2 and (len(mine) == 0) == (width == 0)
        for n in mine:
            assert n.level == 0 or width <= 1 << (63 - n.level)
        for x in (offset, (offset + width - 1) & RING_MASK) if width > 0 else ():
            assert any(n.node == (1 << n.level) + (x >> (63 - n.level)) for n in mine)


def test_last_change_counts(spark):
    schema = "rule_id string, offset long, width long"
    old = spark.createDataFrame([("a", 1, 1), ("b", 2, 2)], schema)
    new = spark.createDataFrame([("b", 8, 8, 1), ("b", 9, 9, 2), ("c", 3, 3, 0)], schema + ", at long")
    got = sorted(tuple(r) for r in R.upsert_rules(old, new, "at").collect())
    assert got == [("a", 1, 1), ("b", 9, 9), ("c", 3, 3)]
    with pytest.raises(ValueError, match="changed twice"):
        R.upsert_rules(old, new)


def test_an_id_is_of_one_kind(spark):
    ring = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "rule_id string, width long")
    scanned = spark.createDataFrame([("d", 0.5)], "rule_id string, rate double")
    rules = R.RuleSet(ring, scanned, {"e": len})

    def ids(s):
        return [sorted(r.rule_id for r in df.collect()) for df in (s.ring, s.scanned)] + [sorted(s.predicates)]

    moved = rules.upsert("scanned", spark.createDataFrame([("b", 0.1), ("e", 0.2)], scanned.schema))
    assert ids(moved) == [["a", "c"], ["b", "d", "e"], []]
    assert ids(moved.upsert("predicates", {"a": len, "d": len})) == [["c"], ["b", "e"], ["a", "d"]]
    assert ids(moved.upsert("ring", spark.createDataFrame([("d", 4)], ring.schema))) == [["a", "c", "d"], ["b", "e"], []]
    assert ids(rules.remove(spark.createDataFrame([("a",), ("e",), ("x",)], "rule_id string"))) == [["b", "c"], ["d"], []]
    with pytest.raises(ValueError):
        rules.upsert("other", ring)
