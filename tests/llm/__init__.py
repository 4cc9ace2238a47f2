"""A package, so that its tests may have the file names of those beside it."""
