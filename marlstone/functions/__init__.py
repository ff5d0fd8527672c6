"""Column functions: Base62 keys, checksums, coercion."""
