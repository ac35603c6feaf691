"""Training-data operators: search, extraction, language, privacy, packing,
decontamination, url, toxicity, near-duplicate and quality stages."""
