"""Operators for preparing training data at corpus scale.  Nothing outside this subpackage
(except the guarded import in ``__spark_entry__.py`` and ``corpus_pipeline.py``) imports it."""
