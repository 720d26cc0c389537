"""Record fan-out over subscription rules and keyed count-window digests on Spark."""
