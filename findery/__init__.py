"""Search and ranking over documents as Spark plans: lexical, semantic and hybrid retrieval, and the data work around it."""

__version__ = "0.1.0"
