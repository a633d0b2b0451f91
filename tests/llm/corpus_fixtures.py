"""Rows of the documents table for tests."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make_docs(spark, rows, extra=False):
    """documents rows from (doc_id, text[, lang, source]); extra adds columns whose names clash with results."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    if extra:
        for c in ("id", "fp", "component", "kept", "score", "block", "u", "v", "rep"):
            df = df.selectExpr("*", f"'x' AS {c}")
    return df
