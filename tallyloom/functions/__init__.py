"""Column functions: hash randomness, text, options and lexicon."""
