"""The registered queries: importing the package fills QUERIES and SQL."""

from anchorline.plans import estimation, queries, shocks, stored, tables  # noqa: F401
