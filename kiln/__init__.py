"""Text-curation and knowledge-graph analytics on Spark DataFrames."""
