"""Every query of the library by name, and its SQL."""

from faultline.queries import QUERIES, SQL, evaluation, features, incremental, learning, quality, sources  # noqa: F401

FLAGSHIP = "A4_history_summary"
