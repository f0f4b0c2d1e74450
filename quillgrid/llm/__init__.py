"""Training-data operators: extraction, packing, scoring, media, dedup, language, URLs, decontamination, secrets."""
