"""Spark-native k-mer analytics over DNA text and a set of corpus operators."""
