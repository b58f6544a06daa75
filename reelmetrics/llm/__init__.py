"""Training-data operators: near and exact dedup, filters, classifiers, mixing, tokenizing."""
