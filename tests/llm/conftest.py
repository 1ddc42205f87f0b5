import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, n_words long, spans string, node long, start long"


@pytest.fixture
def documents(spark):
    """Documents with columns whose names the operators use themselves."""

    def make(rows):
        return spark.createDataFrame([(i, t, lang, "s", None, 0.5, 1, "x", 2, 3) for i, t, lang in ((*r, None)[:3] for r in rows)], DOCS)

    return make


ODD_TEXTS = [
    (None, "a text without an id"),
    (1, None),
    (2, ""),
    (3, " \t\r\n"),
    (4, "one"),
    (4, "one"),
    (5, "..., 123 !?"),
    (6, "Ünï çödé ﷽ 漢字 \U0001f600 a\u0301 ß"),
    (7, "long " * 30_000),
    (8, "x" * 50_000),
    (9, "nul \x00 and \x85 and \u00a0 and \u2581 and \ufdd0 <|endoftext|> end"),
]


@pytest.fixture
def odd(documents):
    return documents(ODD_TEXTS)


@pytest.fixture
def none(documents):
    return documents([])
