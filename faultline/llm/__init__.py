"""Training-data operators for sequences and texts; nothing outside this subpackage imports it."""
