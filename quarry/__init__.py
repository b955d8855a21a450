"""quarry: retrieval and index analytics expressed as Spark plans."""
