"""Training-data operators: search, quality, formatting, tokens, packing, scoring, licences, archives, duplicates, languages,
conversation structure, whitening."""
