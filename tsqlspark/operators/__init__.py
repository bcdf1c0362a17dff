"""Statements that change tables, and the checks on what they write."""
