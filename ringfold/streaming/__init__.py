"""The fan-out and the digests on unbounded input."""
