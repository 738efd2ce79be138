"""Errors a user can act on."""


class DatasetError(Exception):
    """The dataset cannot be used as configured; the message says what to change."""


class HistoryTooShort(DatasetError):
    """The data does not cover enough time for a chronological train / validation / test split."""
