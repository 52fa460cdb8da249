import pytest

WORDS = "the of and to in that is was for on are as with his they at be this from have".split()


@pytest.fixture
def frame(spark):
    """Documents from (doc_id, text, source) rows, with columns whose names clash with ours."""
    def make(rows, parts=3):
        rows = [(*r, "src")[:3] for r in rows]
        return spark.createDataFrame(
            [(i, t, "en", s, None, 1, "x") for i, t, s in rows],
            "doc_id long, text string, lang string, source string, n_chars long, v long, doc string",
        ).repartition(parts)
    return make


def sentence(rng, n, words=WORDS):
    return " ".join(rng.choice(words) + rng.choice(["", "", "er", "ing", "s"]) for _ in range(n))
