"""Training-data operators: ten distributed text operators and their queries."""
