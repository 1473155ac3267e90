"""Binds the shared test tables to the library's five input tables, and holds the check SQL."""
