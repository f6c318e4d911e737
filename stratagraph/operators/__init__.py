"""Relational, graph and search operators."""
