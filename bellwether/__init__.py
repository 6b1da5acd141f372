"""Company ranking from news, posts and prices, as Spark DataFrames."""
