"""Training-data operators: each module is one operator; ``queries`` holds the thin registered queries and their SQL."""
