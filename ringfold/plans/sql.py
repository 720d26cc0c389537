"""SQL twins of the registered queries, for a value check in another engine.

They follow the definition of each operator directly (every record against every rule,
a window per rule), and share no shortcut with the Spark side.
"""

from __future__ import annotations

MASK = "9223372036854775807"


def unsigned(digits: str) -> str:
    return f"('0x' || {digits})::UBIGINT"


def masked(digits: str) -> str:
    return f"({unsigned(digits)} & {MASK}::UBIGINT)::BIGINT"


def signed(digits: str) -> str:
    u = unsigned(digits)
    negative = f"{u}::HUGEINT - 18446744073709551616::HUGEINT"
    return f"(CASE WHEN {u} > {MASK}::UBIGINT THEN {negative} ELSE {u}::HUGEINT END)::BIGINT"


def hash16(text: str) -> str:
    return f"substr(md5({text}), 1, 16)"


def position(data: str) -> str:
    """``data`` is an expression for the record's bytes in hex."""
    return masked(hash16(f"unhex(substr({data}, 1, 32))"))


def width(p: str) -> str:
    return f"(CASE WHEN {p} >= 1 THEN (-9223372036854775808)::BIGINT ELSE floor({p} * pow(2, 63))::BIGINT END)"


def in_arc(position: str, offset: str, width: str) -> str:
    ahead = f"{position} >= {offset} AND {position} - {offset} < {width}"
    wrapped = f"{position} < {offset} AND {position} < greatest({width}, 0) - 1 - ({MASK} - {offset})"
    return f"({width} < 0 OR ({ahead}) OR ({wrapped}))"


def wrap(total: str) -> str:
    two64 = "18446744073709551616::HUGEINT"
    two63 = "9223372036854775808::HUGEINT"
    return f"(((({total})::HUGEINT + {two63}) % {two64} + {two64}) % {two64} - {two63})::BIGINT"


def sampled(hex_data: str, seed: str, rate: str) -> str:
    h = masked(hash16(f"encode({seed} || ':') || unhex(substr({hex_data}, 1, 32))"))
    return f"{h} <= floor({rate} * pow(2, 63))::BIGINT"


def hex_long(x: str) -> str:
    return f"lpad(to_hex({x}), 16, '0')"


MS = "(epoch_us(ts) // 1000)"
#: Of a record without a time.
MS_OR_0 = f"coalesce({MS}, 0)"

REC_EVENTS = f"""
rec AS (
  SELECT event_id AS record_id, ts, upper(md5(event_id::VARCHAR)) AS data FROM events
)"""

REC_DOCS = """
rec AS (
  SELECT doc_id AS record_id, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id) AS ts,
         hex(encode(text)) AS data
  FROM documents
)"""

PADDED_DOCS = REC_DOCS.replace("rec AS", "all_rec AS") + """,
rec AS (SELECT record_id, ts, CASE WHEN length(data) < 16 THEN rpad(data, 16, '0') ELSE data END AS data FROM all_rec)"""

PREPARED = f"""
prepared AS (
  SELECT record_id, ts, data, {position('data')} AS position, {signed('substr(data, 1, 16)')} AS first_long
  FROM rec
)"""


def rules_from(source: str) -> str:
    """Rule table over rows ``(rule_no, selectivity)`` named by ``source``."""
    return f"""
rules AS (
  SELECT 'consumer_' || rule_no AS rule_id, rule_no::BIGINT AS rule_no, selectivity,
         {masked("substr(md5('seed:' || rule_no), 1, 16)")} AS "offset", {width('selectivity')} AS width
  FROM {source}
)"""


def zipf(total: float, s: float, numbers: str) -> str:
    return f"""
weights AS (SELECT rule_no, 1.0::DOUBLE / pow(rule_no + 1, {s}::DOUBLE) AS weight FROM {numbers}),
selectivities AS (
  SELECT rule_no, round(weight / (SELECT sum(weight) FROM weights) * {total}::DOUBLE, 12) AS selectivity FROM weights
)"""


def subscriptions(total: float = 5.0, s: float = 1.0) -> str:
    return zipf(total, s, "(SELECT c_custkey AS rule_no FROM customer)") + "," + rules_from("selectivities")


MATCHES = f"""
matches AS (
  SELECT r.rule_id, p.*
  FROM prepared p JOIN rules r ON {in_arc('p.position', 'r."offset"', 'r.width')}
)"""


def numbered(every: int, phase: str = "0", source: str = "matches") -> str:
    return f"""
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY ts NULLS FIRST, record_id) - 1 AS idx,
         {phase} AS phase
  FROM {source}
),
placed AS (SELECT *, idx + phase AS pos, (idx + phase) // {every} AS cycle FROM numbered)"""


def digest(every: int) -> str:
    return f"""
folded AS (
  SELECT rule_id, cycle, count(*) AS n_records, {wrap('sum(first_long::HUGEINT)')} AS total,
         min_by(CASE WHEN pos % {every} = 0 THEN {MS_OR_0} ELSE 0 END, pos) AS start_ms,
         max_by({MS_OR_0}, pos) AS end_ms, max(pos) AS last_pos
  FROM placed GROUP BY rule_id, cycle
),
digests AS (
  SELECT rule_id, cycle::BIGINT AS cycle, {every}::BIGINT AS n, n_records, total, start_ms::BIGINT AS start_ms,
         end_ms::BIGINT AS end_ms
  FROM folded WHERE last_pos % {every} = {every} - 1
)"""


DIGEST_ROWS = "SELECT rule_id, cycle, n, n_records, total, start_ms, end_ms FROM digests"


def query(*ctes: str, select: str) -> str:
    return "WITH " + ",".join(c.strip("\n") for c in ctes) + "\n" + select


DELIVERIES = f"""
deliveries AS (
  SELECT event_id, ts, {MS} AS end_ms, {MS} + (event_id * 7919 % 12000 - 500) AS append_ms FROM events
),
samples AS (
  SELECT *, CASE WHEN append_ms - end_ms >= 0 THEN 'latency' ELSE 'negative' END AS sign,
         abs(append_ms - end_ms) AS latency
  FROM deliveries
)"""


def bounds_table(bounds: list[float]) -> str:
    rows = ", ".join(f"({i}, {b}::DOUBLE)" for i, b in enumerate(bounds))
    return f"bounds(bucket, le) AS (VALUES {rows})"


HOURS = """
hours AS (
  SELECT date_trunc('hour', ts) AS ts, count(*) AS n, count(*) FILTER (event_id % 50 <> 0) AS done,
         count(*) FILTER (event_id % 2 = 0) AS n0, count(*) FILTER (event_id % 2 = 1) AS n1
  FROM events GROUP BY 1
)"""

LAG_SAMPLES = HOURS + """,
lag_samples AS (
  SELECT ts, sum(n) OVER w AS end_offset, sum(done) OVER w AS committed_offset
  FROM hours WINDOW w AS (ORDER BY ts ROWS UNBOUNDED PRECEDING)
)"""

OFFSET_LOG = HOURS + """,
offset_log AS (
  SELECT (epoch_us(ts) // 3600000000)::BIGINT AS batch_id,
         '{"input":{"0":' || sum(n0) OVER w || ',"1":' || sum(n1) OVER w || '}}' AS json
  FROM hours WINDOW w AS (ORDER BY ts ROWS UNBOUNDED PRECEDING)
),
exploded AS (
  SELECT batch_id, 'input' AS topic, p.partition::INTEGER AS partition,
         (json::JSON -> 'input' ->> p.partition)::BIGINT AS "offset"
  FROM offset_log, (VALUES ('0'), ('1')) p(partition)
)"""
