"""Column expressions: every function takes and returns Spark columns and stays in the JVM."""
