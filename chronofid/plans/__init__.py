"""Score families and table repair: DataFrame in, DataFrame out."""
