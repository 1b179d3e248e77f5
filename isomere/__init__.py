"""Isomere: coverages (grids, series, profiles, tracks, polygons) as Spark tables and plans."""
