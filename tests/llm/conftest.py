import pytest

from keyloom.llm import common

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """documents from texts, or from (doc_id, text) pairs."""

    def make(texts, lang="en"):
        rows = [x if isinstance(x, tuple) else (i, x) for i, x in enumerate(texts)]
        return spark.createDataFrame([(i, t, lang, None, len(t or "")) for i, t in rows], DOCS)

    return make


@pytest.fixture
def real(spark):
    return lambda name: common.table(spark, "/root/testdata/sf0.001", name)


@pytest.fixture
def odd():
    return [None, "", " ", "a", "a b", "ÀB c d", "x" * 5000, "word " * 3000, "line\nline\n\n line", "日本語 テキスト 🙂", "it's we're 'sand\t\r\n  end  ", "<|endoftext|> a"]
