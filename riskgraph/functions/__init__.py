"""Column expressions; everything here stays inside JVM code."""

from .base import *  # noqa: F401,F403
from .pages import *  # noqa: F401,F403
from .risk import *  # noqa: F401,F403
from .search import *  # noqa: F401,F403
from .subjects import *  # noqa: F401,F403
from .text import *  # noqa: F401,F403
from .urls import *  # noqa: F401,F403
