"""lexmill: PySpark-native analytics over collections of regulatory and web documents."""
