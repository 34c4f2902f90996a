"""Training-data operators: mixing, exact search, fingerprints, language
models, packing, extraction, language id, toxicity, near-duplicate and
line de-duplication. Nothing outside this subpackage imports it."""
