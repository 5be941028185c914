"""keyloom: a Spark-native keyspace engine; batches of key-value commands as DataFrame plans."""
