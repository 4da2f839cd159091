"""Column functions: identity, paths, comments, scores. All stay inside the JVM."""
