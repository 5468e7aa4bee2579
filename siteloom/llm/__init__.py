"""Training-data operators over the documents table; nothing else in the package imports them."""
