"""All registered queries."""

from . import checks_pages, checks_tables  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
