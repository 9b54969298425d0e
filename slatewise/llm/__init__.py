"""Training-data operators: token counts, language, near copies, quality, secrets, toxicity, packing, decontamination, token files."""
