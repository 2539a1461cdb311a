"""Feeds as Structured Streaming: the same folds as in batch, plus lateness and sinks."""
