"""Compilation of the syntax tree into one DataFrame plan."""
