"""Streams of queries against a static collection."""
