"""Column functions and the fixed lists they use."""
