"""Analytics operators: DataFrame in, lazy DataFrame out."""
