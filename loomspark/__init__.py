"""Spark-native engine that turns heterogeneous documentation into queryable knowledge bundles."""
