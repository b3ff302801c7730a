import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, component_id string, score string, Text int, `n tokens` int"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes documents with extra, clashing columns from (doc_id, text[, lang[, source]]) tuples."""

    def make(rows):
        full = []
        for doc_id, text, *more in rows:
            lang, source = [*more, None, None][:2]
            full.append((doc_id, text, lang, source, None if text is None else len(text), "x", "y", 1, 2))
        return spark.createDataFrame(full, COLUMNS)

    return make


PROSE = (
    "It was a bright cold day in April and the clocks were striking thirteen while Winston Smith slipped quickly "
    "through the glass doors of the mansions though not quickly enough to keep a swirl of gritty dust from entering"
)
ODD_TEXTS = [None, "", " ", "\n\t ", "a", "x" * 5000, "naïve 漢字 ١٢٣ 　 \x1c end", "word " * 3000, PROSE, PROSE, PROSE + " " + PROSE, "it's 'll  we're\n\n\tok "]


@pytest.fixture(scope="session")
def odd(docs):
    """Documents with null, empty, white, long, repeated and mixed texts, null ids and repeated rows."""
    rows = [(i, t, "en" if i % 2 else None, None) for i, t in enumerate(ODD_TEXTS)]
    return docs([*rows, (None, PROSE), (None, None), (8, PROSE), (8, PROSE)])


@pytest.fixture(scope="session")
def empty(docs):
    return docs([]).limit(0)
