"""Intermediate tables in the folder that driver and executors share: the engine's own."""

from ..sources.scratch import Scratch, shared_dir

__all__ = ["Scratch", "shared_dir"]
