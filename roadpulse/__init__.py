"""Vehicle-telemetry analytics as plain DataFrame functions on Spark."""
