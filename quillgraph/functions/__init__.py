"""Column functions on text: cleaning, keys, similarity, spans."""
