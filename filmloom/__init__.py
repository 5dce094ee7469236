"""Spark operators for the data side of video restoration and colorization."""
