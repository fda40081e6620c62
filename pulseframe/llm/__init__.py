"""Training-data operators: text, markup, media and classifier jobs over Spark tables."""
