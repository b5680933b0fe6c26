"""Part of the memory engine; see the README."""
