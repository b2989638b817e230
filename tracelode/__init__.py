"""tracelode: analytics over execution traces of tool-using agents, on Spark DataFrames."""
