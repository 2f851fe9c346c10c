"""Policies of batches, windows, retries, errors and lines, with their validation."""

from __future__ import annotations

import random
from dataclasses import dataclass, replace
from datetime import timedelta
from enum import Enum

from .errors import ConfigError
from .errors import ConfigErrorKind as Kind

#: Fixed limits.
DEFAULT_MAX_ITEMS = 1 << 20
DEFAULT_MAX_KEYS = 1 << 20
MAX_SLIDING_OVERLAP = 1024
MAX_BUFFER = 1 << 20
DEFAULT_MAX_LINE = 1 << 20
LONGEST = (1 << 63) - 1
#: Microseconds of about a thousand years; grids of longer sliding windows leave the calendar.
LONGEST_SLIDING = 1 << 55


def micros(d: timedelta) -> int:
    return (d.days * 86_400 + d.seconds) * 1_000_000 + d.microseconds


def _limit(n: int | None, stage: str | None) -> None:
    if n is not None and n < 1:
        raise ConfigError(Kind.ZERO_LIMIT, stage)
    if n is not None and n > LONGEST:
        raise ConfigError(Kind.LIMIT_TOO_LARGE, stage)


def _duration(d: timedelta | None, stage: str | None) -> None:
    if d is not None and micros(d) < 1:
        raise ConfigError(Kind.ZERO_DURATION, stage)


class ErrorPolicy(Enum):
    FAIL_FAST = "fail_fast"
    CONTINUE = "continue"
    DEAD_LETTER = "dead_letter"


class LineOverflow(Enum):
    ERROR = "error"
    SKIP = "skip"
    TRUNCATE = "truncate"


@dataclass(frozen=True)
class BatchPolicy:
    """A batch closes when any limit is met; the item that meets it is inside."""

    items_limit: int | None = None
    bytes_limit: int | None = None
    age_limit: timedelta | None = None

    def max_items(self, n: int) -> "BatchPolicy":
        return replace(self, items_limit=n)

    def max_bytes(self, n: int) -> "BatchPolicy":
        return replace(self, bytes_limit=n)

    def max_age(self, age: timedelta) -> "BatchPolicy":
        return replace(self, age_limit=age)

    @property
    def has_trigger(self) -> bool:
        return not (self.items_limit is self.bytes_limit is self.age_limit is None)

    def validate(self, stage: str | None = None, sized: bool = True) -> None:
        _limit(self.items_limit, stage)
        _limit(self.bytes_limit, stage)
        _duration(self.age_limit, stage)
        if self.bytes_limit is not None and not sized:
            raise ConfigError(Kind.BYTES_REQUIRE_BYTE_SIZE, stage)
        if not self.has_trigger:
            raise ConfigError(Kind.NO_BATCH_TRIGGER, stage)


@dataclass(frozen=True)
class WindowPolicy:
    """``kind``: tumbling, sliding or session; ``step`` is the slide."""

    kind: str
    size: timedelta
    step: timedelta | None = None

    @classmethod
    def tumbling(cls, size: timedelta) -> "WindowPolicy":
        return cls("tumbling", size)

    @classmethod
    def sliding(cls, size: timedelta, slide: timedelta) -> "WindowPolicy":
        return cls("sliding", size, slide)

    @classmethod
    def session(cls, idle: timedelta) -> "WindowPolicy":
        return cls("session", idle)

    def max_items(self, n: int | None) -> "WindowSpec":
        return WindowSpec(self).max_items(n)

    def max_keys(self, n: int | None) -> "WindowSpec":
        return WindowSpec(self).max_keys(n)

    def validate(self, stage: str | None = None) -> None:
        _duration(self.size, stage)
        _duration(self.step, stage)
        if self.step is not None:
            if self.step > self.size:
                raise ConfigError(Kind.SLIDE_EXCEEDS_SIZE, stage)
            if micros(self.size) > LONGEST_SLIDING:
                raise ConfigError(Kind.LIMIT_TOO_LARGE, stage)
            if -(-micros(self.size) // micros(self.step)) > MAX_SLIDING_OVERLAP:
                raise ConfigError(Kind.TOO_MANY_OVERLAPPING_WINDOWS, stage)


@dataclass(frozen=True)
class WindowSpec:
    policy: WindowPolicy
    items_limit: int | None = DEFAULT_MAX_ITEMS
    keys_limit: int | None = DEFAULT_MAX_KEYS

    @classmethod
    def of(cls, spec: "WindowPolicy | WindowSpec") -> "WindowSpec":
        return spec if isinstance(spec, cls) else cls(spec)

    def max_items(self, n: int | None) -> "WindowSpec":
        return replace(self, items_limit=n)

    def max_keys(self, n: int | None) -> "WindowSpec":
        return replace(self, keys_limit=n)

    def validate(self, stage: str | None = None) -> None:
        self.policy.validate(stage)
        _limit(self.items_limit, stage)
        _limit(self.keys_limit, stage)


@dataclass(frozen=True)
class Backoff:
    kind: str = "none"
    first: timedelta = timedelta(0)
    most: timedelta = timedelta(0)

    @classmethod
    def none(cls) -> "Backoff":
        return cls()

    @classmethod
    def fixed(cls, delay: timedelta) -> "Backoff":
        return cls("fixed", delay)

    @classmethod
    def exponential(cls, initial: timedelta, most: timedelta) -> "Backoff":
        return cls("exponential", initial, most)


@dataclass(frozen=True)
class RetryPolicy:
    max_attempts: int
    wait: Backoff = Backoff()
    jittered: bool = False

    def backoff(self, wait: Backoff) -> "RetryPolicy":
        return replace(self, wait=wait)

    def jitter(self, on: bool) -> "RetryPolicy":
        return replace(self, jittered=on)

    def base_delay(self, attempt: int) -> timedelta:
        """The wait after the attempt with this number (from 1), without jitter."""
        if self.wait.kind == "exponential":
            us = micros(self.wait.first) << min(max(attempt, 1) - 1, 63)
            return timedelta(microseconds=min(us, micros(self.wait.most)))
        return self.wait.first if self.wait.kind == "fixed" else timedelta(0)

    def delay(self, attempt: int) -> timedelta:
        base = self.base_delay(attempt)
        return base * random.random() if self.jittered else base

    def validate(self, stage: str | None = None) -> None:
        _limit(self.max_attempts, stage)


def check_buffer(capacity: int, stage: str | None = None) -> None:
    if capacity > MAX_BUFFER:
        raise ConfigError(Kind.LIMIT_TOO_LARGE, stage)
