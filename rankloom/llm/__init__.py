"""Training-data operators: extraction, decontamination, near-duplicates,
exact search, language identification, language-model scoring, subword
encoding, personal data, toxicity and quality. Nothing else in the library
imports this subpackage."""
