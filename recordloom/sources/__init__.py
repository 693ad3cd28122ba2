"""recordloom.sources."""
