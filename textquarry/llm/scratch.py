"""Intermediate tables in the folder that all executors share."""

from ..sources.scratch import Scratch, shared_folder

__all__ = ["Scratch", "shared_folder"]
