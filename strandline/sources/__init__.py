"""Sources of the sequence-analytics engine."""
