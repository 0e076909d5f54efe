"""Reading and writing graphs, text renderings, logs."""
