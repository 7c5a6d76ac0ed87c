import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHING = ("fp", "row", "digest", "run", "size", "key", "kind", "id", "body", "task", "rank", "tail", "n", "component_id", "start", "tree", "node", "score", "c0", "words", "target", "block", "url_", "_id", "root", "suspect")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def make(spark):
    """Documents of (id, text[, source]) rows, with columns whose names operators use inside."""

    def of(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        from pyspark.sql import functions as F

        df = spark.createDataFrame(full, SCHEMA).repartition(3)
        return df.withColumns({c: F.lit(7) for c in CLASHING if c not in df.columns})

    return of


@pytest.fixture(scope="session")
def sample(spark):
    """[(doc_id, text)] of the smallest documents table, and the table."""
    df = spark.read.parquet(f"{SF}/documents.parquet")
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], df
