"""Registries of what to compute, and the registered queries."""
