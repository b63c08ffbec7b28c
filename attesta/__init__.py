"""attesta: Spark-native operators for auditing text written about behavioural data."""
