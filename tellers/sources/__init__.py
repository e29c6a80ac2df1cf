"""Landed feed pages and the table store."""
