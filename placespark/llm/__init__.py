"""Training-data operators: one module for each, plus shared text, storage and graph helpers."""
