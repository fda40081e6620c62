"""Column expressions: times, keys, hashes, target codes, score vectors."""
