"""DataFrame operators: DataFrame in, DataFrame out, lazy unless noted."""
