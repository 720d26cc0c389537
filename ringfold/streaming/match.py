"""Fan-out of a record stream over static rules."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame

from ringfold.operators.fanout import BROADCAST_BYTES, match_records
from ringfold.operators.rules import rule_nodes
from ringfold.workdir import stored


def stream_match(
    records: DataFrame,
    rules: DataFrame | None = None,
    scanned: tuple[DataFrame, Callable] | None = None,
    predicates: Mapping[str, Callable] | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Match a prepared record stream against all kinds of rules, as ``match_records`` does.

    The rule index and the scanned rules are stored once, since a stream plans its static
    sides anew for every micro-batch.
    """
    nodes = None if rules is None else stored(rule_nodes(rules), "rule-nodes")
    if scanned is not None:
        scanned = (stored(scanned[0], "scanned-rules"), scanned[1])
    return match_records(records, rules, scanned, predicates, broadcast_bytes, nodes=nodes)
