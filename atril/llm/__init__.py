"""Training-data operators: token counts, near-dedup, language models, mixing, filters, archives, media, quality, text extraction, BPE."""
