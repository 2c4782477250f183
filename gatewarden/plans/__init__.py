"""Physical helpers: durable intermediate tables and skew-safe joins."""
