"""Training-data operators: filters, packing, mixing, extraction, media and near-duplicate detection."""
