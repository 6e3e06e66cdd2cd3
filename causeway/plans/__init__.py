"""Fixture graphs, graphs drawn from tables, and the registered queries."""
