"""Streams of activity. An extension: stored logs are read in batches otherwise."""
