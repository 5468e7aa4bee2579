"""Web-corpus audit analytics expressed as Spark plans."""
