"""Streamflow analytics on Spark: river networks, lateral inflow, unit hydrographs and Muskingum routing."""

__version__ = "0.1.0"
