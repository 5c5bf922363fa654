"""cairn: analytics over relational, document and conversation data as PySpark pipelines."""
