"""Training-data operators: each module is one operator, ``queries`` applies them to the tables."""
