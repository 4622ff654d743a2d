"""graphloom: graph, corpus and memory-table analytics on Spark DataFrames."""
