"""Functions of the voxel analytics library."""
