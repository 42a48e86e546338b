"""Column functions: text, addresses, similarity kernels, transliteration."""
