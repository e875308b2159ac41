"""Shared plan shapes, table views and the registered queries."""
