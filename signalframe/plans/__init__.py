"""Immutable query builders; each compiles to one DataFrame plan."""
