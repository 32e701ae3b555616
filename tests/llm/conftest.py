import pytest

from tidegauge.llm.registry import importable

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture()
def docs(spark):
    """Make a documents table with clashing extra columns: docs([(doc_id, text, ...)])."""
    importable(spark)

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, COLUMNS)
        clash = {c: "x" for c in ("n_words", "size", "kept", "ids", "n_tokens", "score", "rank", "node", "bucket", "_n", "shard", "secrets")}
        from pyspark.sql import functions as F

        return df.select("*", *[F.lit(v).alias(c) for c, v in clash.items()])

    return make
