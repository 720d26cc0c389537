"""Byte-level fields of records and events, and sums that wrap at 64 bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ringfold.functions.ring import hex_to_long

LONG_BYTES = 8
DIGEST_BYTES = 4 * LONG_BYTES
PHASE_BYTES = 32


def require_state_bytes(state_bytes: int, minimum: int = DIGEST_BYTES) -> int:
    """A digest needs 32 bytes of state, a counter 8; fewer is an error at plan time."""
    if state_bytes < minimum:
        raise ValueError(f"state size must be at least {minimum} bytes, not {state_bytes}")
    return state_bytes


def long_at(data: Column, index: int) -> Column:
    """The ``index``-th big-endian 64-bit integer of a byte string."""
    return hex_to_long(F.hex(F.substring(data, LONG_BYTES * index + 1, LONG_BYTES)))


def leading_long(data: Column) -> Column:
    """First 8 bytes as a signed big-endian integer; a shorter record is an error."""
    return F.when(F.length(data) >= LONG_BYTES, long_at(data, 0)).otherwise(
        F.raise_error(F.lit("record is shorter than 8 bytes")).cast("bigint")
    )


def _long_hex(value: Column) -> Column:
    return F.lpad(F.hex(value.cast("bigint")), 2 * LONG_BYTES, "0")


def event_pack(
    count: Column, total: Column, start_ms: Column, end_ms: Column, payload: Column | None, state_bytes: int
) -> Column:
    """An event as bytes: four big-endian integers, then the payload, zero-filled to size."""
    room = 2 * (require_state_bytes(state_bytes) - DIGEST_BYTES)
    parts = [_long_hex(c) for c in (count, total, start_ms, end_ms)]
    if room:
        body = F.lit("") if payload is None else F.coalesce(F.hex(payload), F.lit(""))
        parts.append(F.rpad(body, room, "0"))
    return F.unhex(F.concat(*parts))


def event_unpack(value: Column) -> dict[str, Column]:
    """The five fields of a packed event."""
    return {
        "n": long_at(value, 0),
        "total": long_at(value, 1),
        "start_ms": long_at(value, 2),
        "end_ms": long_at(value, 3),
        "payload": F.substring(value, DIGEST_BYTES + 1, 1 << 30),
    }


def counter_pack(count: Column, state_bytes: int = LONG_BYTES) -> Column:
    """A counting state as bytes: one big-endian integer, zero-filled to size."""
    require_state_bytes(state_bytes, LONG_BYTES)
    return F.unhex(F.rpad(_long_hex(count), 2 * state_bytes, "0"))


def wrapping_sum(value: Column, piece_bits: int = 22) -> Column:
    """Aggregate: 64-bit sum that wraps on overflow, as the addition of a CPU does.

    The value is cut into pieces whose plain sums cannot overflow, and the carries
    are moved up afterwards. With ``b``-bit pieces a group may hold 2^(63-b) rows:
    the default allows 2^41, ``piece_bits=32`` is enough for 2^31 and adds less.
    Unlike a sum over decimals it stays in long arithmetic and generated code.
    """
    piece_mask = F.lit((1 << piece_bits) - 1)
    shifts = range(0, 64, piece_bits)
    carry = None
    out = None
    for shift in shifts:
        piece = F.sum(F.shiftrightunsigned(value, shift).bitwiseAND(piece_mask))
        carry = piece if carry is None else piece + F.shiftrightunsigned(carry, piece_bits)
        part = F.shiftleft(carry.bitwiseAND(piece_mask), shift)
        out = part if out is None else out.bitwiseOR(part)
    return out
