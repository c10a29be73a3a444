"""Query-by-example similarity search on Spark DataFrames."""

from kindred.plans.search import search
from kindred.session import session

__all__ = ["search", "session"]
