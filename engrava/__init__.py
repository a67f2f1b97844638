"""engrava: analytics over the long-term memory of AI agents, on Spark DataFrames."""
