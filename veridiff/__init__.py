"""A Spark-native engine for finding, explaining and triaging conflicting facts across sources."""
