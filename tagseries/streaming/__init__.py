"""Streaming form of the bucket aggregation (C1) for a live historian feed."""

from .resample_stream import resample_stream, start_resample

__all__ = ["resample_stream", "start_resample"]
