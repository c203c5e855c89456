"""Table schemas, fixed values of the data contracts, and the guards on both."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

# Fixed values of the event contract.
PRODUCTS = ("photo_editor", "notes_app", "file_transfer")
EVENT_TYPES = ("first_open", "app_open", "trial_start", "paid_subscription", "purchase")

MANIFEST = "partition_key string, path string, rows long, bytes long, sha256 string"


class ContractError(ValueError):
    """Data or a request that breaks a declared contract; nothing is repaired silently."""


def require_columns(df: DataFrame, columns: Iterable[str], label: str) -> None:
    """Refuse a frame that lacks any of ``columns``, before any work."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ContractError(f"{label} lacks columns {missing}")
