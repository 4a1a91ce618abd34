"""Text annotation, corpus quality and extraction scoring as Spark DataFrame operators."""

__version__ = "0.1.0"
