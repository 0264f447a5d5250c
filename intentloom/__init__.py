"""Intent-graph analytics on PySpark."""
