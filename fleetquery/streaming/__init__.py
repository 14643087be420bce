"""Stateful streams: the loops of a running fleet in micro-batches."""
