"""textloom: a PySpark-native engine for querying and analysing corpora of linked documents."""

__version__ = "0.1.0"
