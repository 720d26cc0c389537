"""Per-record folds in plain Python, the definition that the Spark operators must meet."""

MASK64 = (1 << 64) - 1


def signed(x):
    x &= MASK64
    return x - (1 << 64) if x >> 63 else x


def counter(records, every):
    """Running count per key; ``records`` are (key, ts_ms, record_id, data)."""
    counts, events = {}, []
    for key, _, record_id, _ in sorted(records, key=lambda r: (r[1], r[2])):
        counts[key] = counts.get(key, 0) + 1
        if counts[key] % every == 0:
            events.append((key, counts[key], record_id))
    return sorted(events)


def digests(records, every, state_bytes, phases=None):
    """Count-window digests with a byte state, reset after each event."""
    states, events = {}, []
    for key, ms, _, data in sorted(records, key=lambda r: (r[1], r[2])):
        room = state_bytes - 32
        if key not in states:
            first = phases[key] if phases else 0
            states[key] = {"count": first, "cycle": 0, "n": 0, "total": 0, "start": 0, "end": 0, "body": bytes(room)}
        s = states[key]
        s["count"] += 1
        s["n"] += 1
        s["total"] = signed(s["total"] + int.from_bytes(data[:8], "big", signed=True))
        if s["count"] == 1:
            s["start"] = ms
        s["end"] = ms
        prefix = data[:room]
        s["body"] = prefix + s["body"][len(prefix) :]
        if s["count"] == every:
            events.append((key, s["cycle"], every, s["n"], s["total"], s["start"], s["end"], s["body"]))
            states[key] = {
                "count": 0, "cycle": s["cycle"] + 1, "n": 0, "total": 0, "start": 0, "end": 0, "body": bytes(room)
            }
    return sorted(events)
