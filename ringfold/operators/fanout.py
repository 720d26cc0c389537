"""Fan-out: every (record, rule) pair whose rule selects the record."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringfold.functions.payload import DIGEST_BYTES, PHASE_BYTES, leading_long, require_state_bytes
from ringfold.functions.ring import in_arc, keyed_hash, ring_position
from ringfold.operators.rules import node_of, rule_nodes
from ringfold.workdir import stored

BROADCAST_BYTES = 128 << 20
ROW_BYTES = 64
MAX_SALTS = 64
PARTITIONS_PER_SALT = 16
#: Copies of a shuffled index in a stream take this many times the broadcast size at most.
COPY_SHARE = 4
#: A segment is hot with more than this share of an even partition's look-ups.
HEAVY_SHARE = 0.25
#: Bounds on the hot segments that are told apart, and on the tasks one is spread over.
MAX_HEAVY = 20_000
MAX_COPIES = 4096
#: Bits per index row in the bitmap of occupied segments, and what a broadcast word of it takes.
OCCUPANCY_BITS = 16
WORD_BYTES = 32
# Fixed value: the default seed of random phases.
PHASE_SEED = 8902763414119392010


def prepare_records(
    records: DataFrame,
    state_bytes: int = DIGEST_BYTES,
    random_phase: bool = False,
    hash: str = "xxhash64",
    phase_seed: int = PHASE_SEED,
    keep_data: bool = False,
) -> DataFrame:
    """Reduce ``(record_id, ts, data)`` to the few columns that matching and digests need.

    The position is computed once per record, not once per candidate rule, and the
    record's bytes are dropped before they are multiplied by the fan-out: only the
    part that fits into the state behind the fixed fields is kept. ``keep_data`` keeps
    them up to the fan-out, for rules that read them.
    """
    require_state_bytes(state_bytes)
    columns = [
        F.col("record_id"),
        F.col("ts"),
        ring_position(F.col("data"), hash).alias("position"),
        leading_long(F.col("data")).alias("first_long"),
    ]
    if state_bytes > DIGEST_BYTES:
        columns.append(F.substring("data", 1, state_bytes - DIGEST_BYTES).alias("prefix"))
    if random_phase:
        phase = keyed_hash(F.substring("data", 1, PHASE_BYTES), phase_seed, hash)
        columns.append(phase.alias("phase_hash"))
    if keep_data:
        columns.append(F.col("data"))
    return records.select(*columns)


def _carried(records: DataFrame) -> list[str]:
    return [c for c in records.columns if c not in ("position", "data")]


def node_profile(nodes: DataFrame) -> dict[int, int]:
    """Bytes of index rows per level: at most 16 rows reach the driver."""
    size = F.sum(F.length("rule_id") + ROW_BYTES)
    return {r["level"]: r["bytes"] for r in nodes.groupBy("level").agg(size.alias("bytes")).collect()}


def default_salts(df: DataFrame) -> int:
    """Salts of a shuffled join: more on a cluster with more shuffle partitions."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(MAX_SALTS, partitions // PARTITIONS_PER_SALT))


def _salted(probes: DataFrame, index: DataFrame, key: str, salts: int | None) -> DataFrame:
    """Shuffle join in which every salt has a copy of the index and a share of the records."""
    salts = salts or default_salts(probes)
    salt = F.pmod(F.xxhash64("record_id"), F.lit(salts)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    return probes.withColumn("salt", salt).join(index.withColumn("salt", copies), [key, "salt"])


def heavy_nodes(probes: DataFrame, partitions: int, share: float = HEAVY_SHARE) -> DataFrame | None:
    """Measured hot segments ``(node, salts)``: those with more than ``share`` of a partition's probes.

    One pass with a sketch of frequent items, whose size does not depend on the records.
    A segment gets as many salts as it needs to leave no task more than its share. There
    are at most ``partitions / share`` such segments, which bounds the table; None without any.
    """
    most = int(min(MAX_HEAVY, -(-partitions // share)))
    top = F.expr(f"approx_top_k(node, {most}, {4 * most})")
    found = probes.agg(F.count("*").alias("total"), top.alias("top")).first()
    fair = share * found["total"] / partitions
    hot = [(r["item"], -(-r["count"] // max(1, int(fair)))) for r in found["top"] or [] if r["count"] > max(fair, 1)]
    if not hot:
        return None
    return probes.sparkSession.createDataFrame([(n, int(min(s, MAX_COPIES))) for n, s in hot], "node bigint, salts int")


def _salted_where_hot(probes: DataFrame, index: DataFrame, hot: DataFrame) -> DataFrame:
    """Shuffle join in which only hot segments are spread; other index rows have one copy."""
    hot = F.broadcast(hot)
    salts = F.coalesce("salts", F.lit(1))
    salted = probes.join(hot, "node", "left").withColumn("salt", F.pmod(F.xxhash64("record_id"), salts).cast("int")).drop("salts")
    copies = index.join(hot, "node", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return salted.join(copies, ["node", "salt"])


def occupancy(index: DataFrame, bits: int) -> DataFrame:
    """A bitmap of occupied segments, hashed to ``bits`` bits: rows ``(word, filled)`` of 64 bits each."""
    bit = _occupancy_bit(F.col("node"), bits)
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), (bit % 64).cast("int"))
    return index.groupBy(F.floor(bit / 64).cast("bigint").alias("word")).agg(F.bit_or(mask).alias("filled"))


def _occupancy_bit(node: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(bits))


def _occupied(probes: DataFrame, index: DataFrame, rows: int, budget: int) -> DataFrame:
    """Probes whose segment may hold a rule. The bitmap is broadcast; it is left out if not even a small one fits."""
    bits = 64 * max(1, min(rows * OCCUPANCY_BITS // 64, budget // WORD_BYTES))
    if bits < 2 * rows:
        return probes
    bit = _occupancy_bit(F.col("node"), bits)
    filled = F.broadcast(occupancy(index, bits))
    met = probes.withColumn("word", F.floor(bit / 64).cast("bigint")).join(filled, "word")
    hit = F.call_function("shiftright", F.col("filled"), (bit % 64).cast("int")).bitwiseAND(F.lit(1)) == 1
    return met.where(hit).select(*probes.columns)


def ring_range_join(
    records: DataFrame,
    rules: DataFrame,
    broadcast_bytes: int = BROADCAST_BYTES,
    salts: int | None = None,
    nodes: DataFrame | None = None,
    profile: Mapping[int, int] | None = None,
) -> DataFrame:
    """Records of :func:`prepare_records` joined to the rules whose arc holds them.

    An equi-join on ring segments with the arc test as residual, never a nested loop.
    A record is looked up once per level that the rule table uses. The measured size
    of the index decides the plan, level by level. Levels that together fit into
    ``broadcast_bytes`` (coarse ones have few rules) are broadcast, and the records are
    not shuffled for them. For the others both sides are shuffled by segment, once for
    all of these levels; a bitmap of occupied segments drops look-ups before the shuffle
    that no rule can meet.

    Segments that a large share of the look-ups goes to are measured, in one more pass
    over a table of records, and spread over as many tasks as they need; only their index
    rows are copied. ``salts`` spreads all segments by a fixed number instead, as is done
    for a stream, where nothing can be measured; there, a large index, whose segments are
    the finer, is copied less often, as each micro-batch shuffles all copies. A rule with a null arc, and a record
    without a position, match nothing.
    """
    given = nodes is not None
    nodes = nodes if given else rule_nodes(rules)
    profile = node_profile(nodes) if profile is None else profile
    coarse, left = [], broadcast_bytes
    for level in sorted(profile, key=lambda k: (profile[k], k)):
        if profile[level] > left:
            break
        coarse.append(level)
        left -= profile[level]
    deep = sorted(set(profile) - set(coarse))
    parts = []
    if coarse or not deep:
        index = nodes.where(F.col("level").isin(coarse)) if deep else nodes
        parts.append(_probes(records, coarse).join(F.broadcast(_index(index)), "node"))
    if deep:
        index, probes = _index(nodes.where(F.col("level").isin(deep))), _probes(records, deep)
        # a large index is read for the bitmap and for the join; one that the caller gives is stored already
        index = index if given else stored(index, "rule-index")
        looked_up = _occupied(probes, index, sum(profile[k] for k in deep) // ROW_BYTES, left)
        if salts or records.isStreaming:
            most = max(1, COPY_SHARE * broadcast_bytes // sum(profile[k] for k in deep))
            parts.append(_salted(looked_up, index, "node", salts or min(most, default_salts(records))))
        else:
            hot = heavy_nodes(probes.select("node"), int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")))
            parts.append(looked_up.join(index, "node") if hot is None else _salted_where_hot(looked_up, index, hot))
    hit = in_arc(F.col("position"), F.col("offset"), F.col("width"))
    found = [joined.where(hit).select("rule_id", *_carried(records)) for joined in parts]
    return reduce(DataFrame.unionAll, found)


def _index(nodes: DataFrame) -> DataFrame:
    return nodes.select("node", "rule_id", "offset", "width")


def _probes(records: DataFrame, levels: Iterable[int]) -> DataFrame:
    """A row per record and level to look up."""
    lookups = _lookups(levels)
    probe = lookups[0] if len(lookups) == 1 else F.explode(F.array(*lookups))
    return records.select("position", *_carried(records), probe.alias("node"))


def _lookups(levels: Iterable[int]) -> list[Column]:
    return [node_of(F.col("position"), level) for level in sorted(levels) or [0]]


def scan_fanout(
    records: DataFrame,
    rules: DataFrame,
    predicate: Callable[[Callable[[str], Column], Column], Column],
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Test every record against every rule of a kind that has no index.

    ``predicate(record, rule)`` gets a function naming a record's column and the rule
    as a struct. It is the residual of a join, so a pair is tested in generated code
    before it is a row, and only hits become rows. Rules are cut into groups of about
    ``broadcast_bytes``, by measured size, and each group is broadcast in a pass of its
    own; records are never copied or shuffled.
    """
    row_bytes = F.length(F.to_json(F.struct(*rules.columns))) + ROW_BYTES
    total = rules.agg(F.coalesce(F.sum(row_bytes), F.lit(0)).alias("bytes")).first()["bytes"]
    groups = max(1, -(-total // max(1, broadcast_bytes)))
    # both sides compute the key, so that it is not taken for a constant and the join stays an equi-join
    probes = records.withColumn("_group", F.pmod(F.xxhash64("record_id"), F.lit(1)))
    grouped = rules.select(
        F.struct(*rules.columns).alias("_rule"),
        F.pmod(F.xxhash64("rule_id"), F.lit(groups)).alias("_part"),
        F.pmod(F.xxhash64("rule_id"), F.lit(1)).alias("_group"),
    )
    carried, hit = _carried(records), predicate(F.col, F.col("_rule"))
    parts = []
    for i in range(groups):
        own = grouped.where(F.col("_part") == i).select("_rule", "_group")
        met = probes.join(F.broadcast(own), (probes["_group"] == own["_group"]) & hit)
        parts.append(met.select(F.col("_rule.rule_id").alias("rule_id"), *carried))
    return reduce(DataFrame.unionAll, parts)


def predicate_fanout(
    records: DataFrame, predicates: Mapping[str, Callable[[Callable[[str], Column]], Column]]
) -> DataFrame:
    """Fan-out over rules given as predicates ``{rule_id: predicate}``.

    A predicate takes a function that names a record's column and returns a Boolean
    column, which may come from a ``pandas_udf``. One pass over the records, no join.
    """
    return records.select(F.explode(_predicate_hits(predicates)).alias("rule_id"), *_carried(records))


def _predicate_hits(predicates: Mapping[str, Callable]) -> Column:
    if not predicates:
        raise ValueError("at least one predicate is needed")
    return F.array_compact(F.array(*[F.when(p(F.col), F.lit(rule_id)) for rule_id, p in predicates.items()]))


def match_records(
    records: DataFrame,
    rules: DataFrame | None = None,
    scanned: tuple[DataFrame, Callable] | None = None,
    predicates: Mapping[str, Callable] | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    salts: int | None = None,
    nodes: DataFrame | None = None,
) -> DataFrame:
    """All matches of all kinds of rules; a record may give none, one or many rows.

    Ring rules and predicates together take one pass over the records while the index is
    small enough to broadcast. Scanned rules, and large indexes, take a pass of their own.
    ``nodes`` is the index of ``rules`` where it is stored already.
    """
    if rules is None and scanned is None and not predicates:
        raise ValueError("no rules given")
    parts = []
    if rules is not None:
        nodes = rule_nodes(rules) if nodes is None else nodes
        profile = node_profile(nodes)
        if predicates and sum(profile.values()) <= broadcast_bytes:
            parts.append(_one_pass(records, nodes, profile, _predicate_hits(predicates)))
            predicates = None
        else:
            parts.append(ring_range_join(records, rules, broadcast_bytes, salts, nodes, profile))
    if scanned is not None:
        parts.append(scan_fanout(records, *scanned, broadcast_bytes=broadcast_bytes))
    if predicates:
        parts.append(predicate_fanout(records, predicates))
    columns = parts[0].columns
    return reduce(DataFrame.unionAll, [p.select(*columns) for p in parts])


def _one_pass(records: DataFrame, nodes: DataFrame, profile: Mapping[int, int], found: Column) -> DataFrame:
    """Ring matches and rules already found, from one explode and one broadcast join.

    A record's probes are the segments to look up and the rules found; the latter have
    no segment, so the outer join passes them through.
    """
    carried = _carried(records)
    lookup = [F.struct(node.alias("node"), F.lit(None).cast("string").alias("found")) for node in _lookups(profile)]
    known = F.transform(found, lambda r: F.struct(F.lit(None).cast("bigint").alias("node"), r.alias("found")))
    probes = records.select("position", *carried, F.explode(F.concat(F.array(*lookup), known)).alias("probe"))
    probes = probes.select("position", *carried, "probe.node", "probe.found")
    index = F.broadcast(nodes.select(F.col("node").alias("segment"), "rule_id", "offset", "width"))
    hit = in_arc(F.col("position"), F.col("offset"), F.col("width"))
    joined = probes.join(index, (F.col("node") == F.col("segment")) & hit, "left")
    rule_id = F.coalesce("found", "rule_id")
    return joined.where(rule_id.isNotNull()).select(rule_id.alias("rule_id"), *carried)


def matches_per_rule(matches: DataFrame) -> DataFrame:
    """Matches of each rule, counted before and after the shuffle by rule."""
    return matches.groupBy("rule_id").agg(F.count("*").alias("n_matches"))


def rule_hit_rate(matches: DataFrame, records: DataFrame, rules: DataFrame) -> DataFrame:
    """Observed share of records per rule, next to the share the rule asks for.

    ``z`` is the deviation in standard errors; it is null where the expected share
    leaves no spread (0, or 1 and above).
    """
    total = records.agg(F.count("*").cast("double")).scalar()
    hits = rules.select("rule_id", "selectivity").join(matches_per_rule(matches), "rule_id", "left")
    n, p = F.col("n_records"), F.least("selectivity", F.lit(1.0))
    return (
        hits.withColumn("n_matches", F.coalesce("n_matches", F.lit(0)))
        .withColumn("n_records", total)
        .withColumn("rate", F.when(n > 0, F.col("n_matches") / n))
        .withColumn("z", F.when((p > 0) & (p < 1) & (n > 0), (F.col("n_matches") - n * p) / F.sqrt(n * p * (1 - p))))
    )
