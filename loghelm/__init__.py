"""Web-server log analytics and detection as plain Spark DataFrame transforms."""

from loghelm.operators.filters import Filters
from loghelm.schema import DATASET_SCHEMA, LOG_SCHEMA
from loghelm.session import build_session, prepare_session

__all__ = ["DATASET_SCHEMA", "Filters", "LOG_SCHEMA", "build_session", "prepare_session"]
