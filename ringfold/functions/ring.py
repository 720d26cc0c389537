"""Hash-ring expressions (all stay inside whole-stage codegen).

A record sits at a position on a ring of 2^63 points, taken from a hash of its
first 16 bytes. A rule selects an arc ``[offset, offset + width)`` of the ring,
or every record when ``width`` is negative.

Two hash families are offered. ``xxhash64`` is the default; ``md5`` gives the
same positions in any SQL engine, which is what the value checks need.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RING_MASK = (1 << 63) - 1
RING_SIZE = float(1 << 63)
MATCH_ALL = -(1 << 63)
HASHED_BYTES = 16
HASHES = ("xxhash64", "md5")


def _check_hash(hash: str) -> None:
    if hash not in HASHES:
        raise ValueError(f"hash must be one of {HASHES}, not {hash!r}")


def hex_to_long(digits: Column) -> Column:
    """Up to 16 hex digits as a signed 64-bit integer."""
    return F.conv(digits, 16, -10).cast("bigint")


def keyed_hash(data: Column, seed: Column | int | str | None = None, hash: str = "xxhash64") -> Column:
    """64-bit hash of a byte string; a different ``seed`` gives an independent hash."""
    _check_hash(hash)
    seed = F.lit(seed) if isinstance(seed, (int, str)) else seed
    if hash == "xxhash64":
        return F.xxhash64(data) if seed is None else F.xxhash64(seed, data)
    if seed is not None:
        data = F.concat(F.encode(F.concat(seed.cast("string"), F.lit(":")), "utf-8"), data)
    return hex_to_long(F.substring(F.md5(data), 1, 16))


def ring_position(data: Column, hash: str = "xxhash64") -> Column:
    """Position of a record: hash of its first 16 bytes, sign bit dropped."""
    prefix = F.substring(data, 1, HASHED_BYTES)
    return keyed_hash(prefix, hash=hash).bitwiseAND(F.lit(RING_MASK))


def rule_offset(seed: int | str, rule_no: Column, hash: str = "xxhash64") -> Column:
    """Start of a rule's arc, derived from the seed and the rule number."""
    _check_hash(hash)
    if hash == "xxhash64":
        raw = F.xxhash64(F.lit(seed), rule_no)
    else:
        text = F.concat(F.lit(f"{seed}:"), rule_no.cast("string"))
        raw = hex_to_long(F.substring(F.md5(text.cast("binary")), 1, 16))
    return raw.bitwiseAND(F.lit(RING_MASK))


def arc_width(selectivity: Column) -> Column:
    """Arc width of a match probability; 1 and above means match-all, below 0 is an error."""
    return (
        F.when(
            F.isnan(selectivity) | (selectivity < 0) | selectivity.isNull(),
            F.raise_error(F.lit("selectivity must be a number that is not negative")).cast("bigint"),
        )
        .when(selectivity >= 1, F.lit(MATCH_ALL))
        .otherwise((selectivity * F.lit(RING_SIZE)).cast("bigint"))
    )


def in_arc(position: Column, offset: Column, width: Column) -> Column:
    """True where ``position`` lies on the arc, also across the ring's end.

    Position and offset are both in [0, 2^63), so the difference cannot overflow.
    """
    distance = (position - offset).bitwiseAND(F.lit(RING_MASK))
    return (width < 0) | (distance < width)


def sample_threshold(rate: Column) -> Column:
    """Largest hash a sampling rule of this rate still accepts."""
    return F.when(rate >= 1, F.lit(RING_MASK)).otherwise((rate * F.lit(RING_SIZE)).cast("bigint"))


def hash_sample(data: Column, seed: Column | int | str, rate: Column | float, hash: str = "xxhash64") -> Column:
    """Repeatable sampling filter: keep a record when its seeded hash is under the rate."""
    rate = F.lit(float(rate)) if isinstance(rate, (int, float)) else rate
    position = keyed_hash(F.substring(data, 1, HASHED_BYTES), seed, hash).bitwiseAND(F.lit(RING_MASK))
    return position <= sample_threshold(rate)
