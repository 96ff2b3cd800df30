"""Plan shapes: ordered chunks, skew-safe joins, exact quantiles, durable cuts."""
