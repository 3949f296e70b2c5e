"""merloom: sequence and mer analytics declared as Spark DataFrame jobs."""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
