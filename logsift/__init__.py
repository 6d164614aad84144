"""Log forensics on Spark."""
