"""gridmeter: smart-meter release, cleaning and revenue/consumption analytics on Spark."""

__version__ = "0.1.0"
