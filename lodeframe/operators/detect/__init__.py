"""Cleaning detectors: what is wrong with a table, as findings."""
