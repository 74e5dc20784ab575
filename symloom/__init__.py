"""Source-code property graphs as DataFrames: build, resolve, query."""
