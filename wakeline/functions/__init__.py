"""Functions of the track-analytics library."""
