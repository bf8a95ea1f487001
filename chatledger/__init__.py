"""Event-sourced chat analytics as Spark jobs: an ordered event log in, chat state out."""
