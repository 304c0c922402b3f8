"""slicekit: sliced evaluation of model outputs as Spark DataFrame plans."""

__version__ = "0.1.0"
