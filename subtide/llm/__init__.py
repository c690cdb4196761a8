"""Training-data operators: media, chat, mixing, scans, filters, fingerprints, packing and de-duplication."""
