"""Record linkage and analytics on Spark DataFrames: anchors are linked to 0..N records of the target tables."""
