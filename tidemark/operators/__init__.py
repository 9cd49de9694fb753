"""Plan builders: DataFrame in, DataFrame out."""
