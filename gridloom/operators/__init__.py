"""Operators of the voxel analytics library."""
