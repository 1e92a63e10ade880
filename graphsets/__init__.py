"""Graph-reasoning data sets built, audited and scored with Spark DataFrames."""
