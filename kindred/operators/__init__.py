"""DataFrame operators: pairing, scaling, ranking, evaluation, labels, derivation."""
