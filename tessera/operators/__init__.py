"""Relational time-series operators: DataFrame in, DataFrame out."""
