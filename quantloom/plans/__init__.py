"""Whole plans: panels, pipelines and the registered queries."""
