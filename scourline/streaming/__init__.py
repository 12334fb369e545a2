"""Row-local rules and windowed metrics over streaming DataFrames."""
