"""Gridded multi-hazard flood analytics as DataFrame transformations."""
