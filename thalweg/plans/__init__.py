"""Routers, configuration, command line and the query catalogue."""
