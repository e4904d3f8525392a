"""Pure Python and NumPy kernels, without Spark."""
