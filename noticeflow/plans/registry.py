"""All registered queries and their SQL."""

from . import extraction, notices, streams, workflow  # noqa: F401
from .base import ORACLE_SQL, QUERIES  # noqa: F401
