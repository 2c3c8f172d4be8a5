"""Plans of the voxel analytics library."""
