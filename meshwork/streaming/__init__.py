"""The engine's workload is a whole graph at rest; it has no streaming operators, and none are made up here."""
