"""Sources of the track-analytics library."""
