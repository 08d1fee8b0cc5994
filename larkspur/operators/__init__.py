"""DataFrame-in, DataFrame-out operators. Each takes ``now`` and every threshold as an argument."""
