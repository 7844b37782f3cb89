"""alertloom: security-alert normalisation, scoring and explanation on Spark DataFrames."""
