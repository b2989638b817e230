"""Column functions: text, time, hashing and metrics. Everything here stays inside the JVM."""
