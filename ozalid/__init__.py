"""ozalid: loading, scoring and evaluating multiple-choice image questions on Spark."""

__version__ = "0.1.0"
