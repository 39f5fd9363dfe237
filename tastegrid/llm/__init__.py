"""Text-corpus operators: tokens, filters, sharding, near-duplicates, decontamination and language models."""
