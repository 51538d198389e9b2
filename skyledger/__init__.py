"""Station temperature quality control and risk fusion on Spark DataFrames."""
