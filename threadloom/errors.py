"""Errors of a compaction run."""


class CompactionError(Exception):
    """Any failure of a run."""


class UnavailableError(CompactionError):
    """No answers could be had, and the run was asked to fail closed."""


class UnsupportedTargetError(CompactionError):
    """What was to be wrapped can't be."""


class BlockedError(CompactionError):
    """A finding blocks the pending action."""

    def __init__(self, message: str, finding: dict | None = None) -> None:
        super().__init__(message)
        self.finding = finding


class AbortedError(CompactionError):
    """The caller cancelled the run."""


class StateTooLargeError(CompactionError):
    """The abridged state is over the limit of a request even at the last stage."""
