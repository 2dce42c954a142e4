import pytest

from fleetframe.llm.common import table

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Names that operators use for their own columns.
CLASHING = "score double, spans string, class bigint, text_hash bigint, held_out string, block int, `values` int, k int, part int, look int, grade int, n int, rep bigint"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, clashing=False):
        rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows]
        df = spark.createDataFrame(rows, DOCS)
        if clashing:
            for field in CLASHING.split(", "):
                name, kind = field.rsplit(" ", 1)
                df = df.selectExpr("*", f"cast(null as {kind}) as {name}")
        return df

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, an empty text, equal and repeated rows, a very long text, a null id."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(40_000))
    return [
        (1, None),
        (2, ""),
        (3, "plain words here and there, nothing else to see"),
        (3, "plain words here and there, nothing else to see"),
        (4, "plain words here and there, nothing else to see"),
        (5, long),
        (6, "x" * 50_000),
        (None, "a row without an id"),
        (7, "   \n\t "),
    ]


@pytest.fixture(scope="session")
def bundled(spark):
    import os

    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(folder):
        pytest.skip("bundled tables are not here")
    return lambda name: table(spark, folder, name)


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}
