"""A PySpark-native retrieval and knowledge-base analytics engine."""

__version__ = "0.1.0"
