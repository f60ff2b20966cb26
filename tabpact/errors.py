"""Errors raised before any data is touched. Each one lists every problem found."""

from __future__ import annotations

from collections.abc import Sequence


class DefinitionError(ValueError):
    """A contract, a binding or a run was declared wrongly."""

    def __init__(self, subject: str, problems: Sequence[str]):
        self.subject = subject
        self.problems = list(problems)
        super().__init__(f"{subject}: " + "; ".join(self.problems))


class SealedError(RuntimeError):
    """Something was put into a sink that has already been closed."""


class RefusedError(ValueError):
    """Raised by a sink's ``put`` for one record that it does not take; the text is the reason."""


def raise_if(subject: str, problems: Sequence[str]) -> None:
    if problems:
        raise DefinitionError(subject, problems)
