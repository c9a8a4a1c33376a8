"""tomeforge: document-collection curation and queries as Spark DataFrames."""
