from plinth.streaming.ingest import append_stream, read_events_stream, windowed_counts

__all__ = ["append_stream", "read_events_stream", "windowed_counts"]
