"""Sources of the catalogue library."""
