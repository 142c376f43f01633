"""Training-data operators over document, page and vector tables."""
