"""Spark-native file-tree synchronisation and audit: directory trees as DataFrames."""
