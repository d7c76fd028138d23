"""newsweir: a PySpark-native engine for news retrieval, ranking and offline evaluation."""
