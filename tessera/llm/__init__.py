"""Training-data operators: PII, decontamination, secrets, mixing, line dedup, toxicity, WARC, near-dedup, LM scoring."""
