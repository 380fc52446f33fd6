"""A PySpark-native analytics engine for large multi-tenant document collections."""
