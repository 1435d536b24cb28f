"""Table operators: DataFrame in, DataFrame out, no global state."""
