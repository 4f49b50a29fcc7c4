"""spindrift: event and signal alignment as Spark jobs."""
