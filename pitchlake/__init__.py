"""A PySpark-native engine for property graphs and text built from semi-structured records."""
