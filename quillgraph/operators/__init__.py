"""Operators on graphs: build, resolve, communities, search, spans."""
