"""Reading and writing: day shards, records, host lists."""
