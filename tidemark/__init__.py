"""Point-in-time analytics expressed as Spark plans."""
