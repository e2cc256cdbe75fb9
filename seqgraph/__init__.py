"""seqgraph: sequence-to-state-graph analytics on PySpark DataFrames."""
