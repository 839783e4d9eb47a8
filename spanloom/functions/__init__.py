"""Column functions: text, morphology, similarity, vectors and ratios."""
