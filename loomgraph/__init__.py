"""loomgraph: a PySpark-native engine for typed property graphs of apps."""
