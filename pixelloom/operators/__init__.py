"""Operators on planes (packed arrays, one image in a row) and on evaluation tables."""
