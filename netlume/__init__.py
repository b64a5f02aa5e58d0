"""A PySpark-native analytics engine for network-telescope packet data."""
