"""Physical-plan building blocks: exact numbering, top-n, skew-safe joins."""
