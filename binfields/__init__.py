"""Spark jobs for very large tables of 3-D point detections on a lattice."""
