"""Replay of message streams against a trained model."""

from .replay import dedupe_unseen, replay_stream

__all__ = ["dedupe_unseen", "replay_stream"]
