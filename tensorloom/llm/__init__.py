"""Training-data operators: ten methods over documents, embeddings, pages and conversations."""
