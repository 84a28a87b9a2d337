"""notemill: analytics over collections of Markdown notes and documents, as Spark DataFrames."""
