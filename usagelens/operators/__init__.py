"""Report operators: DataFrame in, DataFrame out."""
