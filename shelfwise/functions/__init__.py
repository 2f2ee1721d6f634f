"""Functions of the catalogue library."""
