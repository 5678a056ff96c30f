"""Test-prioritization analytics on Spark."""
