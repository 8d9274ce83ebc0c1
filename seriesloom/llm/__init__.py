"""Training-data operators: token files, shards, language, leaks, search, packing, duplicates, web archives."""
