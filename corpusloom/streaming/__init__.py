"""Incremental and stateful queries."""
