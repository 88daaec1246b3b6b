"""Statistics, encodings, layout and metrics around a plan."""
