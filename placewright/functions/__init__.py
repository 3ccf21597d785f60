"""Column expressions: text, time, area and numeric helpers."""
