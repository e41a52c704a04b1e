"""Training-data operators: ten self-contained modules and their registered queries."""
