"""Scene analytics, evaluation-log and comparison operators."""
