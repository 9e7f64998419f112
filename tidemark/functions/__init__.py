"""Column expressions: no actions, no shuffles, all JVM-side."""
