"""Array operators: each computes a CellArray and states the lineage of every argument."""
