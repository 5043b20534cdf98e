"""Options of a compaction, with their defaults."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column


@dataclass(frozen=True)
class Options:
    max_tokens: int = 15000
    keep_recent: int = 4
    pin_code_within: int = 12
    drop_threshold: float = 0.7
    drop_threshold_second_pass: float = 0.5
    min_keep: int = 2
    truncate_head_chars: int = 300
    excerpt_chars: int = 1500
    state_tokens: int = 20000
    request_tokens: int = 56000
    votes: int = 1
    safety_gating: bool = False
    review_threshold: float = 0.35
    action_threshold: float = 0.7
    fail_closed: bool = False
    trigger: str = "always"
    cooldown_turns: int = 1
    format: str = "auto"
    #: None: the built-in patterns. Corrective templates are merged over the built-in ones; False disables them.
    patterns: tuple | None = None
    corrective: dict | bool | None = None
    #: Tokens of a message's JSON, as a function of Columns; None: the estimate by characters.
    count_tokens: Callable[[Column], Column] | None = None

    def __post_init__(self) -> None:
        if self.trigger not in ("always", "auto"):
            raise ValueError("trigger is 'always' or 'auto'")
        if self.format not in ("auto", "openai", "anthropic", "langchain", "plain"):
            raise ValueError(f"unknown format {self.format!r}")
        object.__setattr__(self, "votes", max(1, math.floor(self.votes)))
        object.__setattr__(self, "min_keep", max(0, math.floor(self.min_keep)))
        for name in ("keep_recent", "pin_code_within", "cooldown_turns"):
            object.__setattr__(self, name, max(0, int(getattr(self, name))))

    def merged(self, **changes) -> Options:
        """A copy with the changes that aren't None."""
        return replace(self, **{k: v for k, v in changes.items() if v is not None})


def finite(p: Column) -> Column:
    """Whether a number is one: neither null nor NaN nor infinite."""
    return p.isNotNull() & (p > float("-inf")) & (p < float("inf"))


#: Slack for probabilities that sit on a threshold.
EPSILON = 1e-9
