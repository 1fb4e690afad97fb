"""Spark jobs for time-stamped multi-channel signals and the events that drive them."""
