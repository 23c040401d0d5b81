"""A Spark-native federated SQL analytics engine: registry, SQL front end, relational operators."""

__version__ = "0.1.0"
