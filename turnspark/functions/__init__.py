"""Column functions: text cues, scores and nested signal arrays."""
