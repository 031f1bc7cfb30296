"""Training-data operators: language-model scoring, mixing, sharding, personal data,
deduplication, decontamination, quality and toxicity.  Nothing outside this
subpackage imports it."""
