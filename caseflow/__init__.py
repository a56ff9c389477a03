"""caseflow: cumulative count series from several feeds, as Spark DataFrames."""
