"""Training-data operators: quality, tokenization, privacy, search, formatting, placement and de-duplication."""
