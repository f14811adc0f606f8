"""Column expressions: vectors, names, boxes and schedules."""
