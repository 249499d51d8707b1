"""Column functions built from JVM expressions."""
