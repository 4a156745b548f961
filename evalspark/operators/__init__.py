"""Table operators built from joins, aggregates and windows."""
