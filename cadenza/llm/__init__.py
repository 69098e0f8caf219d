"""Training-data operators: language, duplicates, packing, archives, mixing and quality."""
