"""cairn: set-at-a-time analytics over crawl archives, on PySpark."""
