"""Factor research on Spark: bars, rolling operators, labels, metrics and back-tests as DataFrame jobs."""

__version__ = "0.1.0"
