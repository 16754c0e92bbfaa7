"""Streaming of the track-analytics library."""
