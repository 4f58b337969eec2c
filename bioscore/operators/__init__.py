"""DataFrame operators: pairs, comparison, evaluation, pixels, votes, vectors."""
