"""Rail condition analytics on Spark: telemetry windows, alarms, scoring and history."""
