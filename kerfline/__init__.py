"""kerfline: signal-to-prediction analytics expressed as Spark plans."""
