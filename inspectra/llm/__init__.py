"""Training-data operators: formatting, archives, filters, deduplication, scoring."""
