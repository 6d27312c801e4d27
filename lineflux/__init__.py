"""lineflux: event-log, interval and co-presence analytics on PySpark DataFrames."""
