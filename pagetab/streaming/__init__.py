"""Page transforms applied to streaming DataFrames."""
