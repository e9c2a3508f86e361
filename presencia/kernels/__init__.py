"""Dense numeric kernels, pure numpy."""
