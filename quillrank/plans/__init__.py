"""Registered queries; importing this package registers all of them."""

from quillrank.plans import (  # noqa: F401
    tables,
    source_queries,
    text_queries,
    sparse_queries,
    search_queries,
    mining_queries,
    trainset_queries,
    metric_queries,
    stream_queries,
)
