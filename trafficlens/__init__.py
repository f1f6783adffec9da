"""Access-log analytics on PySpark: parse, period statistics, traffic gauge, time lookups."""
