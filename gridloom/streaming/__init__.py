"""Streaming of the voxel analytics library."""
