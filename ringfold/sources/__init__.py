"""Record sources, event sinks and offset logs."""
