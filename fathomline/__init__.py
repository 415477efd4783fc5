"""Spark-native analytics over long filings text and economic time series."""
