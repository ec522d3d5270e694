"""The engine's shared-folder tables, under this subpackage's name."""

from loam.store import materialize, remove, shared_root, workspace

__all__ = ["materialize", "remove", "shared_root", "workspace"]
