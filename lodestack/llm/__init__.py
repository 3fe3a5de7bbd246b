"""Training-data operators: cleaning, deduplication, mixing and formatting of text corpora."""
