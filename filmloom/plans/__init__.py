"""Plan shapes shared by the operators: ordered work on keys of any size, scratch storage."""
