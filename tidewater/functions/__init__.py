"""Column-level functions and the feature definitions."""
