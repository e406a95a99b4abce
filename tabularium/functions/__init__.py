"""Field decoders as Column expressions, for binary columns that are already in Spark."""
