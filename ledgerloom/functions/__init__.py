"""Column-returning functions; all stay inside the JVM unless said otherwise."""
