"""Streams of points into a store."""
