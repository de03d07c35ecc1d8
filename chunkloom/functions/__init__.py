"""Column functions: each takes and returns ``Column``s and stays inside the JVM."""
