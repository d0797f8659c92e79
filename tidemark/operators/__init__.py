"""DataFrame operators: sequences, windows, features, signals, alignment, statistics, learning."""
