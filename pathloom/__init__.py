"""pathloom: location time series on PySpark, from raw pings to places, trips and scores."""

__version__ = "0.1.0"
