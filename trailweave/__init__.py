"""Regular path queries over edge-labelled graphs, and training-data operators, on Spark DataFrames."""
