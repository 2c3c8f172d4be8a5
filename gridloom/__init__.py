"""Spark-first analytics over 3D city models: meshes, sidecars, encoded grids and voxel tables."""
