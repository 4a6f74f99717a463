"""Profiles of columns and tables over all their rows."""
