"""Small numeric kernels used inside operators."""
