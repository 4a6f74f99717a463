"""Cleaning transforms: each takes a frame and returns a new one; fitted values come from one aggregate."""
