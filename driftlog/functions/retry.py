"""Delays between attempts of a failing operator."""

from __future__ import annotations

from dataclasses import dataclass

#: Fixed value: multiplier of the generator that spreads the delays.
MULTIPLIER = 6364136223846793005


@dataclass(frozen=True)
class RetryConfig:
    """max_attempts 0 means to go on for ever."""

    max_attempts: int = 5
    initial_ms: int = 100
    max_ms: int = 30_000
    jitter: float = 0.25

    def exhausted(self, attempt: int) -> bool:
        return self.max_attempts != 0 and attempt >= self.max_attempts


def backoff_base_ms(config: RetryConfig, attempt: int) -> int:
    """The delay without jitter: doubles from the first attempt on, up to the maximum."""
    return min(config.initial_ms << max(0, min(attempt - 1, 62)), config.max_ms)


def backoff_ms(config: RetryConfig, attempt: int) -> int:
    """The delay before the attempt after this one. The spread is a function of base and attempt
    only, so schedules can be stated; it stays below half the jitter, as 31 random bits are
    measured against 32."""
    base = backoff_base_ms(config, attempt)
    share = ((base + attempt) * MULTIPLIER % (1 << 64) >> 33) / 0xFFFFFFFF
    return base + int(base * config.jitter * share)
