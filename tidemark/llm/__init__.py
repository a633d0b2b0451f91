"""Operators for preparing language-model training corpora.

Nothing outside this subpackage imports it.  Texts travel to Python in Arrow
batches and are handled as flat byte buffers with numpy (`kernel`); whatever has
to meet across documents meets in Spark shuffles of fixed-width entries, and
state between jobs lives in tables under ``spark.checkpoint.dir`` (`scratch`).
"""
