"""Column builders: JVM-side expressions over one row."""
