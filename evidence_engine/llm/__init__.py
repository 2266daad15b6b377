"""Training-data pipeline operators (language ID, URL rules, de-duplication, extraction, packing, ...)."""
