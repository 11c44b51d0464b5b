import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes documents from (doc_id, text) or longer rows; further columns are null."""

    def make(rows):
        full = [tuple(r) + (None,) * (5 - len(r)) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


#: Rows every operator must take: nulls, empties, no words, repeats, a long text, odd signs.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "Ünïcode ß 漢字 \U0001f600 x\x00y"), (None, "no id here"), (None, None),
    (6, "word " * 30_000), (7, "It's 12 o'clock; <|endoftext|> ▁a  b "), (8, "!!! ??? 123"),
]
