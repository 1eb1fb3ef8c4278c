"""strandline: a Spark-native engine for the metadata plane of multi-channel video analytics."""

__version__ = "0.1.0"
