"""Imports every query module so that its queries are registered."""

from runscore.plans import (  # noqa: F401
    compare_queries,
    data_queries,
    metric_queries,
    model_queries,
    reader_queries,
    scoring_queries,
    source_queries,
    stream_queries,
    summary_queries,
    text_queries,
)
