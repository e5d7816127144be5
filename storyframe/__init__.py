"""storyframe: ordered-narrative analytics expressed as Spark DataFrames."""
