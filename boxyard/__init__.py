"""Detection-evaluation jobs for Spark: many datasets, many experiment arms, one plan."""
