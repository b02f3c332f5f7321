"""The error that operations raise."""

from __future__ import annotations


class ArchiveError(Exception):
    """An error with its stable code."""

    def __init__(self, code: str, message: str, report=None):
        super().__init__(message)
        self.code, self.report = code, report

    def __reduce__(self):
        return ArchiveError, (self.code, str(self), self.report)
