"""tessera: recommendation and text-analytics operators as Spark DataFrame plans."""

__version__ = "0.1.0"
