"""Column functions: canonical text and checksums, names, patterns, small conversions."""
