"""Column functions of the language: folding, comparison, similarity, sniffing, chunking."""
