"""Reading and writing turn, trial, label and score tables."""
