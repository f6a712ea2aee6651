"""Analytics over collections of linked Markdown notes, expressed as Spark DataFrames."""
