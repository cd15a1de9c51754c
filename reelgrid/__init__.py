"""Timeline, transcript and operations analytics for video channels, as Spark DataFrames."""
