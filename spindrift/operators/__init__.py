"""DataFrame operators: keys, candidate joins, retrieval channels, features, decisions, metrics."""
