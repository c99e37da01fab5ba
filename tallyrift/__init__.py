"""tallyrift: a PySpark-native engine for uncertain high-utility mining and corpus work."""
