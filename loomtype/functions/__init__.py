"""Column functions: names, qualities, probabilities, texts."""
