"""Training-data operators: cleaning, deduplication, decontamination, tokenizing, archives and chat."""
