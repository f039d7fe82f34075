"""lakeloom: a PySpark-native analytics engine for document collections."""

__version__ = "0.1.0"
