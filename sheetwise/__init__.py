"""Planar-evidence analytics on Spark: operators over tables of drawing primitives."""
