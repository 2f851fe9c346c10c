"""flowspark: ordered record pipelines on Spark DataFrames."""

from .errors import Cancelled, Closed, ConfigError, ConfigErrorKind, DriverError, FlowError, InvalidUtf8, LineTooLong, ReaderError, SinkError, SourceError, StageError, StageFailure
from .policies import DEFAULT_MAX_ITEMS, DEFAULT_MAX_KEYS, MAX_SLIDING_OVERLAP, Backoff, BatchPolicy, ErrorPolicy, LineOverflow, RetryPolicy, WindowPolicy, WindowSpec

__all__ = [n for n in dir() if not n.startswith("_")]
