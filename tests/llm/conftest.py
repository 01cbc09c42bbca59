import random

import pytest

WORDS = {"en": "the of and to in that with for thing ation over under", "de": "der die und zu ein nicht über schön groß keit ung", "fr": "le la des une être où çà élan ment tion", "es": "el los que una más señor ción mente ando"}


@pytest.fixture(scope="session")
def rows():
    """Small documents with every awkward case: null and empty texts, null and repeated ids, copies, near copies, shared passages, a long text."""
    rng = random.Random(5)

    def prose(lang, n):
        vocabulary = WORDS[lang].split()
        return " ".join(rng.choice(vocabulary) + (rng.choice(vocabulary) if rng.random() < 0.5 else "") for _ in range(n))

    shared = prose("en", 60)
    out = []
    for i in range(60):
        lang = list(WORDS)[i % 4]
        text = prose(lang, rng.choice([3, 13, 14, 40, 120]))
        if i % 7 == 0:
            text += " " + shared + "\n" + prose(lang, 20)
        out.append((i, text, lang))
    copy = out[10][1]
    out += [(100 + i, copy, "fr") for i in range(25)]
    out += [(200 + i, copy + f" tail{i}", "fr") for i in range(5)]
    out += [(300, None, None), (301, "", "en"), (302, " \t\n", None), (303, "1234 5678", "en"), (304, "é" * 500, "fr"), (305, "ab" * 400, "en")]
    out += [(None, shared, "en"), (7, out[7][1], "es"), (7, out[8][1], "es"), (306, prose("en", 9000), "en")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with extra columns whose names the operators use themselves."""
    extra = [(i, t, l, "s", len(t or ""), 1, "x", 2, True, "k") for i, t, l in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, _id int, spans string, score int, rejected boolean, _row string").repartition(5)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
