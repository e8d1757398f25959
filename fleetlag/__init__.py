"""Fleet telemetry, timetable and delay analytics expressed as Spark DataFrame jobs."""
