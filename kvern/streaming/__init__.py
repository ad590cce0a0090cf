from kvern.streaming.probe import streamed_matches

__all__ = ["streamed_matches"]
