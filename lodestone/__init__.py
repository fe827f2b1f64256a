"""lodestone: a PySpark-native search, retrieval and corpus analytics engine."""

__version__ = "0.1.0"
