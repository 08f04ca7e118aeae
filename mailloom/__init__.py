"""Mail archive analytics as Spark DataFrame operators and Column functions."""

from mailloom.session import local_session

__all__ = ["local_session"]
