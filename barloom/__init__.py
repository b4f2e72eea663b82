"""barloom: session-bar analytics expressed as Spark DataFrame plans."""
