"""Space-time movement analytics as plain DataFrame functions on Spark."""

from chronoweave.plans import JOBS

__all__ = ["JOBS"]
