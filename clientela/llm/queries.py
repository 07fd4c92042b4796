"""All registered queries of this subpackage."""

from . import chat_queries, page_queries, text_queries, vector_queries  # noqa: F401
from .registry import QUERIES, SQL, query

__all__ = ["QUERIES", "SQL"]


@query()
def pipeline(spark, folder):
    import corpus_pipeline  # it imports this package, and is next to it

    return corpus_pipeline.run(spark, folder)
