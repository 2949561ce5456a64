"""Column functions: units, metrics, kernels."""
