"""Part of the graph engine; see README.md for the map of modules."""
