"""querent: text retrieval, retrieval evaluation and training-data operators as Spark plans."""

__version__ = "0.1.0"
