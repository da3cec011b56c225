"""Registered queries: each composes operators over the input tables."""
