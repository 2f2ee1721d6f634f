"""Operators of a training-data pipeline over text tables.

Nothing outside this subpackage imports it.  Every operator takes a DataFrame
plus column names, reads only the columns it is told to, and never relies on
the names of any others.
"""
