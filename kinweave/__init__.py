"""Record linkage and data preparation expressed as Spark plans."""
