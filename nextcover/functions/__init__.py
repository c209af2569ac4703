"""Column builders. Everything here stays inside the JVM."""
