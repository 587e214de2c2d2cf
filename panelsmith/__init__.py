"""Panelsmith: factor analytics over panel data as lazy Spark plans."""
