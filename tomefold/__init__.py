"""tomefold: a document knowledge engine on Spark.

Main entry points (all take and return DataFrames):

* ``pages_to_markdown`` - HTML pages -> markdown (T0)
* ``chunk_documents`` / ``ChunkParams`` - markdown -> chunks with metadata (T1-T4)
* ``embed_hashed`` / ``embed_with`` - chunk vectors (E1-E3)
* ``knn`` / ``knn_ivf`` - exact / approximate top-k (J2, A7)
* ``search`` / ``RerankRules`` - batch search with rerank and fallback (R1-R10)
* ``ingest_batch_with_errors``, ``append_rows``, ``read_live_index``, ``upsert`` - index
* ``build_index`` / ``answer`` - end-to-end batch jobs
"""

from .operators.chunk import ChunkParams, chunk_documents
from .operators.convert import ARTICLE_SELECTOR, DEFAULT_SELECTOR, MainSelector, pages_to_markdown
from .operators.embed import embed_hashed, embed_with
from .operators.index import append_rows, read_live_index, upsert
from .operators.ingest import changes, coverage, ingest_batch_with_errors
from .operators.knn import knn, knn_ivf
from .operators.search import RerankRules, release, search
from .plans.jobs import answer, build_index

__all__ = [
    "ChunkParams", "chunk_documents", "MainSelector", "DEFAULT_SELECTOR", "ARTICLE_SELECTOR",
    "pages_to_markdown", "embed_hashed", "embed_with", "append_rows", "read_live_index", "upsert",
    "changes", "coverage", "ingest_batch_with_errors", "knn", "knn_ivf", "RerankRules", "release",
    "search", "answer", "build_index",
]
