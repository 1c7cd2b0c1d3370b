"""tapeline: Spark jobs for financial-style tapes: bars, features, barriers, labels, replay and validation."""
