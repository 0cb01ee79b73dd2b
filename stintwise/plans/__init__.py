"""Bindings of the shared tables to the record model, and the query catalogue."""
