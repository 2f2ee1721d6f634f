"""Plans of the catalogue library."""
