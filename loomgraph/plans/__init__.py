"""Plans: the driver's tables as a fact graph, and the queries over it."""
