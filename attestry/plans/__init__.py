"""Contracts, and the catalogue of queries."""
