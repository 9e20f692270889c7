"""Column expressions: casts, times, labels and vectors. All of them stay on the JVM."""
