"""Training-data operators over document, page, conversation and embedding tables."""
