"""DataFrame operators, from raw events to weekly aggregates."""
