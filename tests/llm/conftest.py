import random

import pytest

#: Columns whose names the operators use themselves.
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, size long, words string, block long, digest string, h long, sid long, tree int"


def row(i, text, lang="en", source="s1"):
    return (i, text, lang, source, len(text or ""), 1, "w", 2, "d", 3, 4, 5)


def make_texts(seed=7):
    """Plain words in two languages; copies, near copies, shared passages, repeated lines, odd texts."""
    rng = random.Random(seed)
    vocab = {"en": [f"{a}{b}ing" for a in "bcdfgh" for b in "aeiou"] + ["the", "of", "and"], "fr": [f"{a}é{b}eau" for a in "bcdfgh" for b in "aeiou"] + ["le", "de", "la"]}

    def words(lang, n):
        return [rng.choice(vocab[lang]) for _ in range(n)]

    out = []
    for k in range(30):
        lang = "fr" if k % 3 == 0 else "en"
        out.append((" ".join(words(lang, rng.randrange(30, 120))), lang))
    passage = " ".join(words("en", 45))
    for k in range(5):
        out.append((" ".join(words("en", 20)) + " " + passage + "\n" + " ".join(words("en", 15)), "en"))
    base = words("en", 80)
    for k in range(8):
        near = list(base)
        near[k * 7] = "changed"
        out.append((" ".join(near), "en"))
    out += [(out[0][0], "fr")] * 6 + [(out[1][0] + " ", "en")]
    line = " ".join(words("en", 12))
    out.append(("\n".join([line] * 6), "en"))
    out += [("", "en"), ("", None), (None, "en"), (" \n\t ", "en"), ("one", "en"), ("one two three", None), ("ONE Two three", "en"), ("12 34 ###", "en")]
    out.append((" ".join(words("en", 9000)), "en"))
    out.append(("x" * 30000, None))
    out.append(("naïve　wide 😊 text\x1cjoined\x85here " + " ".join(words("fr", 30)), "fr"))
    return out


@pytest.fixture(scope="session")
def docs(spark):
    rows = [row(3 * k + 1, t, lang, None if k % 11 == 0 else f"s{k % 4}") for k, (t, lang) in enumerate(make_texts())]
    return spark.createDataFrame(rows, CLASHING).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], CLASHING)


@pytest.fixture(scope="session")
def odd(spark):
    """Rows without id, and one row twice."""
    return spark.createDataFrame([row(None, "a b c d e f"), row(5, "same text here"), row(5, "same text here"), row(None, None), row(6, "a b c d e f")], CLASHING)
