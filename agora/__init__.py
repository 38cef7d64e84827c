"""agora: forum deliberation analytics expressed as Spark DataFrame plans.

Sub-packages
------------
functions  column expressions and fixed value tables (text cleaning, KL, scores)
sources    readers, stand-in views over the test tables, JSON dump ingest, sinks
operators  set-based operators: domains, thread structure, graph/PageRank,
           tokens and phrases, topics, quality, clustering, summaries
plans      the registered queries (name -> DataFrame builder) and their SQL twins
streaming  the stateless cleaning chain applied to a file stream
"""

__all__ = ["session"]
