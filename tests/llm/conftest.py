import pytest


@pytest.fixture(scope="session")
def rows(spark):
    """rows(schema, [tuples], columns with clashing names too) as a DataFrame in several partitions."""

    def make(schema, values, parts=3):
        return spark.createDataFrame(values, schema).repartition(parts)

    return make


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside themselves.
CLASH = "kept boolean, vertex long, digest string, range int, shard int, size long, range_id int, row_key long, runs binary, rid long, `n words` int, bucket long, host string"


@pytest.fixture(scope="session")
def docs(rows):
    """docs([(doc_id, text), ...], clash): a table of documents, with columns of clashing names if wanted."""

    def make(pairs, clash=False, parts=3):
        values = [(i, t, "en", "src0", len(t or "")) for i, t in pairs]
        if not clash:
            return rows(DOCS, values, parts)
        return rows(f"{DOCS}, {CLASH}", [(*v, True, 5, "d", 1, 2, 3, 4, 5, b"x", 6, 7, 8, "h") for v in values], parts)

    return make
