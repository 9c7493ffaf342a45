"""Sequence libraries as Spark plans, and operators on text corpora (``seqloom.llm``)."""

from .api import *  # noqa: F403
from .api import __version__, filter, init, join  # noqa: F401

init()
