"""recordloom.plans."""
