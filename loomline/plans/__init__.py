"""Composed studies and the catalogue of named queries."""
