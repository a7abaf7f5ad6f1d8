"""scenespark: Spark jobs over scene graphs and over the question logs run on them."""

__version__ = "0.1.0"
