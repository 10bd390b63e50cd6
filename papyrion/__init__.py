"""A PySpark-native engine for captured web pages: extraction, clean-up, composition, sync planning and training-data preparation."""

__version__ = "0.1.0"
