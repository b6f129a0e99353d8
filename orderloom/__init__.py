"""Order analytics as Spark jobs: snapshots, diffs, merges, text tagging, search and similarity."""
