"""listloom: consolidate overlapping event listings into one catalog on Spark."""

from listloom.session import get_spark

__all__ = ["get_spark"]
