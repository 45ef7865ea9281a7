"""Analytics and curation of a Markdown-notes corpus, declared on Spark DataFrames."""
