"""vecloom: vector clustering, factorised centroids and corpus preparation on Spark DataFrames."""
