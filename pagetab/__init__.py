"""Page-table analytics on Spark: URL admission, page text, robots rules and bounded site frontiers."""
