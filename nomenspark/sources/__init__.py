"""Readers of the domain's text formats. All of them are DataFrame plans over Spark's own text and JSON readers, so any file
system that Spark opens will do; records are found by line separators, so large files split between tasks."""
