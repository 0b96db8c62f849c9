"""Training-data operators: near-dedup, archives, packing, decontamination, scans, classification, counting and search."""
