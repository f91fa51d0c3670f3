"""Operators on frames of points, ranges, blocks and files."""
