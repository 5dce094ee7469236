"""Imports every query module, which fills the registry."""

from filmloom.catalog import (  # noqa: F401
    file_queries,
    frame_queries,
    log_queries,
    manifest_queries,
    model_queries,
    pixel_queries,
    scene_queries,
    stream_queries,
)
from filmloom.catalog.registry import QUERIES

FLAGSHIP = QUERIES["e6_scene_representative"]
