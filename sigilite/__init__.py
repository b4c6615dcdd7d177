"""sigilite: a Spark-native engine that finds secrets and personal data in text tables."""

__version__ = "0.1.0"
