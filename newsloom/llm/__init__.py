"""Training-data operators: ten corpus operators and the queries over them.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
