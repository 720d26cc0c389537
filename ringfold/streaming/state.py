"""Keyed stateful folds on a stream, with Spark's state store.

A fold sees a key's new rows in arrival order and the key's state. It is called with
columns, once per key and micro-batch, not row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ringfold.functions.payload import DIGEST_BYTES, require_state_bytes
from ringfold.functions.timing import epoch_ms
from ringfold.operators.digest import ARRIVAL
from ringfold.operators.folds import Fold, field_names

STATE_STORES = {
    "rocksdb": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "in_memory": "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider",
}
# Rules are hashed into so many buckets; part of the layout of a stream's state.
BUCKETS = 1024
# One entry per rule of the bucket; ``next_pos`` is where the rule's next record goes.
DIGEST_STATE = (
    "rule_ids array<string>, next_pos array<bigint>, n_records array<bigint>, total array<bigint>, "
    "start_ms array<bigint>, end_ms array<bigint>, payload array<binary>"
)
DIGEST_FIELDS = (
    "rule_id string, cycle bigint, n bigint, n_records bigint, total bigint, "
    "start_ms bigint, end_ms bigint, payload binary"
)


def use_state_store(spark: SparkSession, store: str) -> None:
    """Choose the state store of streams started from now on."""
    if store not in STATE_STORES:
        raise ValueError(f"state store must be one of {sorted(STATE_STORES)}, not {store!r}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORES[store])


def stateful_fold(
    matches: DataFrame,
    fold: Fold,
    output_schema: str,
    state_schema: str,
    mode: str = "update",
    key: str = "rule_id",
    in_order: bool = False,
) -> DataFrame:
    """Run a fold per key over a stream. State never expires; there is no watermark.

    Rows are folded as they arrive, one Arrow batch at a time, whatever the size of a key.
    ``in_order`` sorts a key's rows of one micro-batch by time, which makes results
    repeatable. It holds all of them, so it asks for a source with a cap on micro-batches.
    """
    names, arrival = field_names(output_schema), list(ARRIVAL)

    def run(own: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if in_order:
            chunks = [pd.concat(list(chunks), ignore_index=True).sort_values(arrival, ignore_index=True, na_position="first")]
        current = state.get if state.exists else None
        for rows in chunks:
            if len(rows):
                current, out = fold(own[0], current, rows)
                if len(out):
                    yield out if isinstance(out, pd.DataFrame) else pd.DataFrame(out, columns=names)
        state.update(current)

    return matches.groupBy(key).applyInPandasWithState(
        run, output_schema, state_schema, mode, GroupStateTimeout.NoTimeout
    )


def digest_fold(every: int, state_bytes: int = DIGEST_BYTES) -> Fold:
    """The count-window digest of all rules of a bucket, as one vectorised fold."""
    room = require_state_bytes(state_bytes) - DIGEST_BYTES
    fields = ["n_records", "total", "start_ms", "end_ms"]

    def overlaid(under: bytes, prefixes: list[bytes]) -> bytes:
        for prefix in prefixes:
            under = bytes(prefix) + under[len(prefix) :]
        return under

    def seen_through(lengths: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Rows longer than all that follow in their piece; later ones cover the others."""
        high = int(lengths.max(initial=0)) + 1
        back = (lengths - piece * high)[::-1]
        covered = np.maximum.accumulate(back)[:-1]
        return np.concatenate([[True], back[1:] > covered])[::-1] if len(back) else np.zeros(0, bool)

    def fold(key: int, state: tuple | None, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        rows = rows.sort_values("rule_id", kind="stable")
        ids = rows["rule_id"].to_numpy()
        ms = rows["ms"].to_numpy(dtype=np.int64)
        longs = rows["first_long"].to_numpy(dtype=np.int64)
        begins = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        sizes = np.diff(np.append(begins, len(ids)))

        # the kept state as a table, with a row for every rule seen now or before
        columns = ["next_pos", *fields, "payload"]
        kept = pd.DataFrame(dict(zip(columns, state[1:])), index=state[0]) if state else pd.DataFrame(columns=columns)
        fresh = [r for r in ids[begins] if r not in kept.index]
        new = pd.DataFrame(0, index=fresh, columns=columns).astype({"payload": object})
        new["payload"] = [bytes(room)] * len(fresh)
        if "phase_hash" in rows:
            first = pd.Series(rows["phase_hash"].to_numpy()[begins], index=ids[begins])
            new["next_pos"] = first.reindex(fresh).to_numpy(dtype=np.int64) % every
        table = pd.concat([kept, new]) if len(kept) else new
        place = table.index.get_indexer(ids[begins])
        seen = table["next_pos"].to_numpy(dtype=np.int64)[place]

        # cut the rows where a rule or a window begins, and add up each piece
        pos = np.arange(len(ids)) - np.repeat(begins, sizes) + np.repeat(seen, sizes)
        cut = pos % every == 0
        cut[begins] = True
        lo = np.flatnonzero(cut)
        hi = np.append(lo[1:], len(ids))
        owner = np.repeat(place, sizes)[lo]
        resumed = pos[lo] % every != 0
        old = {f: np.where(resumed, table[f].to_numpy(dtype=np.int64)[owner], 0) for f in fields}
        piece = {
            "n_records": hi - lo + old["n_records"],
            # 64-bit addition wraps, which is what the digest asks for
            "total": np.add.reduceat(longs, lo) + old["total"],
            "start_ms": np.where(resumed, old["start_ms"], ms[lo]),
            "end_ms": ms[hi - 1],
        }
        payload = [b""] * len(lo)
        if room:
            # of each window only the rows that later ones leave visible, mostly one
            prefixes, under = rows["prefix"].to_numpy(), table["payload"].tolist()
            lengths = rows["prefix"].str.len().to_numpy(dtype=np.int64)
            shown = np.flatnonzero(seen_through(lengths, np.repeat(np.arange(len(lo)), hi - lo)))
            first, last_shown = np.searchsorted(shown, lo), np.searchsorted(shown, hi)
            payload = [
                overlaid(under[o] if r else bytes(room), prefixes[shown[a:b]])
                for a, b, o, r in zip(first, last_shown, owner, resumed)
            ]

        full = pos[hi - 1] % every == every - 1
        events = pd.DataFrame(
            {
                "rule_id": ids[lo][full],
                "cycle": pos[lo][full] // every,
                "n": every,
                **{f: piece[f][full] for f in fields},
                "payload": [p for p, done in zip(payload, full) if done],
            }
        )

        # a rule goes on from its last piece, which leaves nothing behind when it is full
        last = np.flatnonzero(np.append(owner[1:] != owner[:-1], True))
        after = {"next_pos": table["next_pos"].to_numpy(dtype=np.int64).copy()}
        after["next_pos"][owner[last]] = pos[hi[last] - 1] + 1
        for f in fields:
            after[f] = table[f].to_numpy(dtype=np.int64).copy()
            after[f][owner[last]] = np.where(full[last], 0, piece[f][last])
        rest = table["payload"].tolist()
        for i in last:
            rest[owner[i]] = bytes(room) if full[i] else payload[i]
        arrays = [after[c].tolist() for c in ("next_pos", *fields)]
        return (table.index.tolist(), *arrays, rest), events

    return fold


def stateful_digest(
    matches: DataFrame,
    every: int = 10,
    state_bytes: int = DIGEST_BYTES,
    mode: str = "update",
    buckets: int = BUCKETS,
    in_order: bool = False,
) -> DataFrame:
    """Count-window digests of a match stream, state kept in the state store.

    Rules are hashed into buckets, and a bucket's rules are folded in one call: a call
    per rule would cost more than the fold. ``buckets``, ``every`` and ``state_bytes`` are
    the layout of the state and must not change between restarts; ``start_job`` sees to
    that. For ``in_order`` see :func:`stateful_fold`.
    """
    bucketed = matches.select(
        F.pmod(F.xxhash64("rule_id"), F.lit(buckets)).cast("int").alias("bucket"),
        "*",
        F.coalesce(epoch_ms(F.col("ts")), F.lit(0)).alias("ms"),
    )
    fold = digest_fold(every, state_bytes)
    return stateful_fold(bucketed, fold, DIGEST_FIELDS, DIGEST_STATE, mode, "bucket", in_order)
