"""Spark-native analysis of time series of spatial snapshots.

Subpackages: ``sources`` (readers and the snapshot store), ``operators`` (selection, cleaning, windows,
matrix decompositions, spectra, dynamic models and the data-preparation operators), ``functions`` (small
numeric kernels), ``plans`` (registered queries), ``streaming`` (Structured Streaming forms).
"""

__version__ = "0.1.0"
