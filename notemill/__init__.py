"""notemill: document-corpus processing as declarative Spark plans."""
