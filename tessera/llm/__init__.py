"""Training-data operators: media, mixing, licences, packing, secrets, deduplication, language, tokens, quality."""
