"""Training-data operators: ten corpus-scale steps built on DataFrames.

Nothing else in the library imports this subpackage; it may be deleted
together with ``tests/llm`` and ``corpus_pipeline.py``.
"""
