"""Analytics over captured search pages, web pages, query lists and outcome logs, on Spark DataFrames."""
