"""Plans of the track-analytics library."""
