import random

import pytest

DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns whose names could clash with the operators' own.
CLASHING = "text string, doc_id bigint, id bigint, t string, key string, sig bigint, ha bigint, tokens string, n_tokens string, weight string, epoch string, is_duplicate string, keep_id string, predicted_lang string, toxicity string, start string, stop string, `group` string, component string, source string, lang string"


@pytest.fixture(scope="session")
def words():
    """Random words, the same in each run."""
    r = random.Random(5)
    syllables = "ba co di fu ge ha jo ku li mo na pe qi ro su ta ve wo xa zu".split()

    def make(n, seed=None):
        rng = random.Random(seed) if seed is not None else r
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def clashing(spark):
    """Turns (id, text, lang, source) rows into a table with many other columns, all of them told by the id."""

    def make(rows):
        names = [c.strip().split()[0].strip("`") for c in CLASHING.split(",")]
        full = []
        for i, t, lang, source in rows:
            known = {"doc_id": i, "text": t, "lang": lang, "source": source, "id": 7, "sig": 8, "ha": 9}
            full.append(tuple(known.get(n, f"other-{i}") for n in names))
        return spark.createDataFrame(full, CLASHING)

    return make
