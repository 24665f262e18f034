"""rankloom: ranked-retrieval experiments as Spark DataFrame jobs.

Every stage takes and returns Spark DataFrames: corpus preparation,
term and vector tables, BM25 candidate generation, reranking, score
fusion, evaluation against relevance judgments, tuning and the
comparison of methods.
"""

__version__ = "0.1.0"
