"""Training-data operators: quality, toxicity, near and exact dedup, chat formatting,
mixing, secret scans, sharding and tokenisation. Nothing outside this subpackage imports it."""
