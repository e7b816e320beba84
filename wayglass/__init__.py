"""wayglass: road networks, roadside cameras, routes and places as Spark DataFrames."""
