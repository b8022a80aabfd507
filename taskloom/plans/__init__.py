"""Pipelines, report views and the registered queries."""
