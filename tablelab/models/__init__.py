"""Model families, search, ensembles and evaluation on Spark ML."""
