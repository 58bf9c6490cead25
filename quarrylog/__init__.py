"""Log analytics on Spark: files, streams and tables of log lines, answered with DataFrame plans."""
