"""Intentionally empty: the engine's scope has no unbounded sources, so there is
no watermark, window state or streaming sink to express."""
