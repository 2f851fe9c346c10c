"""What can go wrong: configuration, source, stage, sink, cancelling, drivers."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum
from typing import Any


class ConfigErrorKind(Enum):
    ZERO_DURATION = "a duration must be longer than zero"
    ZERO_LIMIT = "a limit must be larger than zero"
    SLIDE_EXCEEDS_SIZE = "the slide must not be longer than the window"
    TOO_MANY_OVERLAPPING_WINDOWS = "too many windows overlap"
    NO_BATCH_TRIGGER = "a batch needs a limit of items, bytes or age"
    BYTES_REQUIRE_BYTE_SIZE = "a limit of bytes needs batch_bytes"
    DEAD_LETTER_SINK_MISSING = "dead letters need a sink"
    LIMIT_TOO_LARGE = "a limit is too large"
    SHARED_DIR_MISSING = "a cluster needs spark.checkpoint.dir, a folder that all executors share"


class FlowError(Exception):
    """Base of all errors; ``stage`` names the part that failed, ``cause`` is what it raised."""

    label = "error"

    def __init__(self, stage: str | None = None, cause: BaseException | str | None = None):
        self.stage, self.cause = stage, cause
        super().__init__(self._text())

    def _text(self) -> str:
        where = f"{self.label} `{self.stage}`" if self.stage else self.label
        return where if self.cause is None else f"{where}: {self.cause}"

    def inner(self) -> BaseException | str | None:
        return self.cause

    into_inner = inner

    def downcast(self, kind: type) -> Any:
        """The cause, if it is of this type."""
        return self.cause if isinstance(self.cause, kind) else None

    @property
    def is_cancelled(self) -> bool:
        return isinstance(self, Cancelled)


class SourceError(FlowError):
    label = "source"


class StageError(FlowError):
    label = "stage"


class SinkError(FlowError):
    label = "sink"


class DriverError(FlowError):
    label = "driver"


class Cancelled(FlowError):
    label = "cancelled"


class Closed(FlowError):
    label = "pipeline is closed"


class ConfigError(FlowError):
    label = "configuration of"

    def __init__(self, kind: ConfigErrorKind, stage: str | None = None):
        self.kind = kind
        super().__init__(stage, kind.value)

    def with_stage(self, stage: str) -> "ConfigError":
        return ConfigError(self.kind, stage)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, ConfigError) and (self.kind, self.stage) == (other.kind, other.stage)

    def __hash__(self) -> int:
        return hash((self.kind, self.stage))


class ReaderError(Exception):
    """A line that a reader does not take; ``line`` counts from 1."""

    def __init__(self, line: int, text: str):
        self.line = line
        super().__init__(f"line {line}: {text}")


class LineTooLong(ReaderError):
    def __init__(self, line: int, limit: int):
        self.limit = limit
        super().__init__(line, f"longer than {limit} bytes")


class InvalidUtf8(ReaderError):
    def __init__(self, line: int):
        super().__init__(line, "invalid UTF-8")


@dataclass
class StageFailure:
    """A dead letter: the stage, what it raised, how often it tried, and the input where it is known."""

    stage: str
    error: str
    input: Any = None
    attempts: int = 1
    error_type: str = field(default="", compare=False)

    def take_input(self) -> Any:
        got, self.input = self.input, None
        return got
