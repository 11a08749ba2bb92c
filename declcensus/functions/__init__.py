"""Column functions: every one is a pure expression that stays on the JVM."""
