"""Column expressions. All of them stay inside the JVM and need no shuffle."""
