"""Customer and booking analytics as PySpark DataFrame operators and plans."""
