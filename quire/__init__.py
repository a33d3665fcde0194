"""quire: article archives, text search and question answering on Spark."""

__version__ = "0.1.0"
