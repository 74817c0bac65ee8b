"""Import every plan module so their queries register."""

from halcyon.plans import claims_queries, note_queries, stats_queries, model_queries, stream_queries, scored_queries  # noqa: F401,I001
