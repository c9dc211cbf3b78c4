"""Change streams, rate limits and metrics."""
