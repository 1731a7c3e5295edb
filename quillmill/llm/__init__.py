"""Training-data operators: dedup, archives, token counts, extraction, decontamination, packing, filters, chat."""
