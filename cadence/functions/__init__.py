"""Column helpers and the two distributed building blocks: running totals and exact quantiles."""
