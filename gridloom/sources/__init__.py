"""Sources of the voxel analytics library."""
