"""Operators of the track-analytics library."""
