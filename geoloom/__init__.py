"""A geovariable engine on PySpark, with operators that prepare training data."""

from geoloom.engine import Calculator, WorkerMode

__all__ = ["Calculator", "WorkerMode"]
