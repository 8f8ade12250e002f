"""A Spark-native analytics engine for sustainability filings."""
