"""Training-data operators (WARC index, PII, language ID, near-dedup, quality,
exact dedup, decontamination, mixing, toxicity, secrets).  Nothing outside this
subpackage imports it."""
