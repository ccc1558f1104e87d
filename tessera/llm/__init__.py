"""Training-data operators: near-dedup, nearest neighbours, extraction, line dedup, decontamination,
URL rules, tokenising, sharding, language ID and licence scans. Nothing outside this package imports it."""
