"""Jobs composed of the operators, and the queries registered over the given tables."""
