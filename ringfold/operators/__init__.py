"""Rule tables, fan-out joins, count-window digests and measurements."""
