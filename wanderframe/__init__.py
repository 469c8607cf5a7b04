"""Random walks over large multigraphs, and the data processing around them, on Spark."""
