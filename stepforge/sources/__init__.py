"""Readers, validators and sinks."""

from stepforge.sources.tables import latest, spread, table

__all__ = ["latest", "spread", "table"]
