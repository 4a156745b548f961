"""Readers, sinks and the incremental feature cache."""
