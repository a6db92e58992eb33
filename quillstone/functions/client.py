"""Policies of calling a model service: pace, retries, budgets of tries, and clients by provider. Transport and clock are handed in."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

# Seconds between calls by part of the model's name, first match, and for others.
DELAYS = (("free", 6.0), ("claude", 3.0), ("gpt", 2.0))
OTHER_DELAY = 4.0
# The answers that stand in where a model gives none.
EMPTY_ANSWER = {"answer": {"eligibility": "", "outcome_justification": "", "payment_justification": None}}
ERROR_ANSWER = {"answer": {"eligibility": "Error", "outcome_justification": "", "payment_justification": None}}


def recommended_delay(model: str) -> float:
    return next((s for part, s in DELAYS if part in model.lower()), OTHER_DELAY)


def wait_until(reset_ms: int, now: Callable[[], float] = time.time) -> float:
    return max(0.0, reset_ms / 1000 - now())


class Refused(Exception):
    """The service answered with a status and headers."""

    def __init__(self, status: int, headers: dict[str, str] | None = None):
        super().__init__(f"status {status}")
        self.status, self.headers = status, headers or {}


@dataclass
class Pace:
    """At most per_minute calls, slower when the service says that few are left, and none before it resets."""

    per_minute: float = 12.0
    few: int = 3
    now: Callable[[], float] = time.time
    sleep: Callable[[float], None] = time.sleep
    delay: float = field(init=False)
    last: float | None = None
    remaining: int | None = None
    reset: float | None = None

    def __post_init__(self) -> None:
        self.delay = 60.0 / self.per_minute

    def wait(self) -> None:
        if self.reset is not None and self.now() < self.reset:
            self.sleep(self.reset - self.now())
        if self.reset is not None and self.now() >= self.reset:
            self.reset = self.remaining = None
        if self.last is not None and self.now() - self.last < self.delay:
            self.sleep(self.delay - (self.now() - self.last))
        self.last = self.now()

    def heard(self, headers: dict[str, str]) -> None:
        """Take in what the headers say; those that are no numbers are ignored."""
        try:
            if "x-ratelimit-remaining" in headers:
                self.remaining = int(headers["x-ratelimit-remaining"])
            if "x-ratelimit-reset" in headers:
                self.reset = int(headers["x-ratelimit-reset"]) / 1000
        except ValueError:
            return
        if self.remaining is not None and self.remaining < self.few:
            self.delay = max(2 * self.delay, 5.0)

    def status(self) -> dict:
        since = None if self.last is None else self.now() - self.last
        return {"per_minute": self.per_minute, "delay": self.delay, "since_last": since, "remaining": self.remaining, "reset": self.reset, "ready": since is None or since >= self.delay}


def called(send: Callable[[str], tuple[str, dict[str, str]]], prompt: str, pace: Pace, tries: int = 3) -> str:
    """What the service says to a prompt. Refusals for pace and unexpected errors are tried again after 2, 4, 8 seconds or the reset; other refusals are raised at once."""
    for n in range(1, tries + 1):
        try:
            pace.wait()
            said, headers = send(prompt)
            pace.heard(headers)
            return said
        except Refused as e:
            if e.status != 429:
                raise
            pace.heard(e.headers)
            if n == tries:
                raise
            pace.sleep(max(2.0**n, (pace.reset or 0.0) - pace.now()))
        except Exception:
            if n == tries:
                raise
            pace.sleep(2.0**n)
    raise ValueError("tries must be positive")


_CLIENTS: dict[str, Callable[[str], Callable[[list[str]], list[str]]]] = {}
PROVIDERS = ("openai", "hf", "qwen", "openrouter")


def register_client(provider: str, make: Callable[[str], Callable[[list[str]], list[str]]]) -> None:
    """make takes a model's name and gives a function of prompts to replies; it is called once in each worker that needs it."""
    _CLIENTS[provider] = make


def client(provider: str, model: str) -> Callable[[list[str]], list[str]]:
    """A provider's client for a model. Local providers hand hosted names on to the hosted one. None of them is built in."""
    if provider in ("hf", "qwen") and model.startswith("openrouter/"):
        provider = "openrouter"
    if provider not in _CLIENTS:
        raise ValueError(f"no client for provider {provider!r}; registered: {', '.join(_CLIENTS) or 'none'}; known names: {', '.join(PROVIDERS)}")
    return _CLIENTS[provider](model)
