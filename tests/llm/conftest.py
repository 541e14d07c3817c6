import pytest

WORDS = "the of and to in was that with from have this there which their would about other after first water".split()


@pytest.fixture(scope="session")
def documents(spark):
    """Texts with copies, near copies, shared passages, nulls, blanks and a column whose name clashes."""
    import random

    rng = random.Random(7)
    say = lambda n: " ".join("".join(rng.choice(WORDS) for _ in range(rng.randint(1, 2))) for _ in range(n))
    texts = [say(rng.randint(5, 60)) for _ in range(40)]
    texts += texts[:5] + [texts[0]] * 10
    near = say(80).split()
    for i in range(12):
        near[i * 5] = say(1)
        texts.append(" ".join(near))
    passage = say(20)
    texts += [say(10) + " " + passage + " " + say(10) for _ in range(8)]
    texts += [None, "", "   ", "...", "1234 !!", "Äpfel über größer", "x" * 3000, "ab " * 2000, "TWO words", "two WORDS"]
    rows = [(i, t, "de" if t and "ü" in t else "en" if i % 3 else None, f"s{i % 4}" if i % 7 else None, 1.5) for i, t in enumerate(texts)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double")
