"""inkspan: note retrieval, reranking and ranking evaluation on Spark DataFrames."""
