"""Project files, settings and the stored tables."""
