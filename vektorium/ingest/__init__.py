"""From documents to sections, chunks, row numbers and embeddings."""
