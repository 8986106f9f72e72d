"""Training-data operators (near-duplicates, mixing, private data, language,
decontamination, token files, quality, exact search, language model, lines)."""
