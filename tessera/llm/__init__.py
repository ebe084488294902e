"""Training-data operators: dedup, archives, packing, secrets, chat, tokenising, classifiers and URL filters."""
