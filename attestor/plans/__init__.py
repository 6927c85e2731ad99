"""Whole programs and the registered queries."""
