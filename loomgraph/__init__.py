"""A fact graph engine on Spark: nodes, edges and omitted facts as DataFrames, and the operators over them."""
