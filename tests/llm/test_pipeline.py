"""Each stage of the pipeline against brute force on a small set of documents."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wharfline.llm import simhash

from .test_operators import brute_repeats, components

WORDS = [f"{a}{b}" for a in ("stone", "water", "bridge", "garden", "winter", "letter", "market", "window") for b in ("", "s", "ing", "er", "ful", "less", "y", "ish")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    import random

    rng = random.Random(11)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    item = "Which bridge was built of stone before the winter market? It was the garden bridge by the water."
    passage = say(60)
    long = say(300).split()
    texts = [say(rng.randint(30, 80)) for _ in range(20)]
    texts += [texts[0], " ".join(long), " ".join([*long[:150], "oddly", *long[151:]]), say(20) + " " + passage, passage + " " + say(20), "before " + item + " after", "1234 5678 !!", None, ""]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([*rows, rows[5]], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, item


def test_stages(spark, folder):
    path, rows, item = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names = docs.columns
    stages = [f for _, f in corpus_pipeline.STAGES]

    first = corpus_pipeline.materialise(stages[0](spark, docs, path), "t")
    lettered = {i: t for i, t, *_ in rows if t and any(c.isalpha() for c in t)}
    assert first.columns == names and {r.doc_id for r in first.collect()} == set(lettered) and first.count() == len(lettered) + 1

    second = corpus_pipeline.materialise(stages[1](spark, first, path), "t")
    fps = {i: simhash.fingerprint(t) for i, t in lettered.items()}
    groups = components(fps, [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4])
    assert second.columns == names and sorted(r.doc_id for r in second.collect()) == sorted(set(groups.values()))
    assert 20 not in {r.doc_id for r in second.collect()}

    third = corpus_pipeline.materialise(stages[2](spark, second, path), "t")
    kept = {r.doc_id: r.text for r in third.collect()}
    want = brute_repeats([(i, lettered[i]) for i in set(groups.values())])
    assert third.columns == names
    assert {(i, len(t.encode())) for i, t in kept.items()} == {(i, n - gone) for i, n, gone, *_ in want if gone < n}
    assert any(gone for _, _, gone, *_ in want)
    assert all(r.n_chars == len(r.text) for r in third.collect())

    fourth = corpus_pipeline.materialise(stages[3](spark, third, path), "t")
    assert fourth.columns == names and {r.doc_id for r in fourth.collect()} == {i for i, t in kept.items() if item not in t} != set(kept)

    pieces = stages[4](spark, fourth, path).collect()
    ends = {}
    for r in sorted(pieces, key=lambda r: (r.doc_id, r.start)):
        assert r.start == ends.get(r.doc_id, 0)
        ends[r.doc_id] = r.start + r.length
    assert set(ends) == {r.doc_id for r in fourth.collect()} and all(ends[r.doc_id] == r.doc_tokens for r in pieces)


def test_run_equals_its_stages(spark, folder):
    path, *_ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, path), "t")
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(corpus_pipeline.run(spark, path)) == key(docs)


def test_empty_documents(spark, folder, tmp_path):
    path, *_ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_by_general_rule(spark):
    """Copies at a five-word similarity of 0.8 to 0.9 go, less alike ones and rows without an id stay."""
    import random

    rng = random.Random(5)
    texts = []
    for n in (60, 100, 150, 240):
        base = [f"{rng.choice(WORDS)}{rng.randint(0, 99)}" for _ in range(n)]
        texts.append(" ".join(base))
        for changed in (1, 2, 3, 5):
            texts.append(" ".join("other" if (i + 3) % (n // changed) == n // changed // 2 else w for i, w in enumerate(base)))
        texts += [" ".join(base[: round(n * 0.85)]), " ".join(base[n // 3 :])]
    texts += ["one two", "ONE\ttwo", "one three", "", None, " "]
    rng.shuffle(texts)
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(texts)]
    rows += [rows[0], rows[3], (None, texts[1], "s"), (rows[2][0], texts[5], "s")]

    def shingles(text):
        words = (text or "").lower().split()
        return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()

    sets = [shingles(t) for _, t, _ in rows]
    alike = lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b)
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if alike(sets[a], sets[b])]
    middle = [len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in pairs if sets[a] != sets[b]]
    assert sum(0.8 <= s < 0.9 for s in middle) >= 8
    groups = components(range(len(rows)), pairs)
    first = {}
    for at, (i, _, _) in enumerate(rows):
        if i is not None:
            first[groups[at]] = min(first.get(groups[at], i), i)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(first.values())
    assert [r.text for r in got if r.doc_id is None] == [texts[1]]
    where = {(i, t): groups[at] for at, (i, t, _) in enumerate(rows)}
    assert sorted(where[r.doc_id, r.text] for r in got if r.doc_id is not None) == sorted(first)


def test_leaks_by_row(spark, folder):
    """A leaked text goes under a null id, too, and takes no other text of its id with it."""
    path, rows, item = folder
    leaked = "before " + item + " after"
    docs = spark.createDataFrame([(None, leaked), (1, rows[0][1]), (1, leaked), (None, rows[1][1]), (2, None)], "doc_id long, text string")
    got = corpus_pipeline.leaks(spark, docs, path).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted([(1, rows[0][1]), (0, rows[1][1]), (2, "")])


def test_language_without_labels(spark, folder):
    path, rows, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumns({"lang": F.lit(None).cast("string"), "_lang": F.lit("clash")})
    got = corpus_pipeline.language(spark, docs, path)
    assert got.columns == docs.columns and got.count() == docs.count()


def test_repeats_keep_own_characters(spark, folder):
    """Replacement characters of a text's own stay; a character of which a byte goes goes whole; columns of other names come through."""
    path, *_ = folder
    passage = "ein längerer Absatz, der in zwei Texten steht und über fünfzig Bytes hat"
    rows = [(1, "ü" + passage + "ä"), (2, "keep \ufffd here ñ" + passage + "ö also \ufffd"), (3, "\ufffd alone"), (None, passage), (4, None), (2, "x" * 70), (5, "z " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_chars": F.length("text").cast("long"), "kept": F.lit("clash"), "carried": F.lit(1), "n_bytes": F.lit(2)})
    got = corpus_pipeline.repeats(spark, docs, path)
    assert got.columns == docs.columns
    texts = sorted((str(r.doc_id), r.text or "") for r in got.collect())
    want = {(1, rows[0][1]), (2, "keep \ufffd here ñ also \ufffd"), (3, rows[2][1]), (None, passage), (4, ""), (2, "x" * 70), (5, rows[6][1])}
    assert texts == sorted((str(i), t) for i, t in want) and all(r.kept == "clash" and r.n_bytes == 2 for r in got.collect())


def test_stages_clear_only_what_the_one_before_wrote(spark, folder, tmp_path):
    """Runs over two folders in turn don't delete each other's tables."""
    path, *_ = folder
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(12).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = {p: spark.read.parquet(f"{p}/documents.parquet") for p in (path, str(tmp_path))}
    for _, stage in corpus_pipeline.STAGES:
        results = {p: stage(spark, d, p) for p, d in docs.items()}
        docs = {p: corpus_pipeline.materialise(r, "t") for p, r in results.items()}
    assert all(d.count() for d in docs.values())


def test_columns_of_any_name_come_back(spark, folder):
    """Columns with the names that stages use for themselves keep their values."""
    path, rows, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumns({"_lang": F.lit("mine"), "_SCORE": F.lit("own"), "_row": F.lit(7), "__row": F.col("doc_id")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, path), "t")
        got = docs.collect()
        assert got and all((r._lang, r._SCORE, r._row, r["__row"]) == ("mine", "own", 7, r.doc_id) for r in got)


def test_batches_of_python_workers_are_bounded(spark, folder):
    """Whatever the length of the texts; a bound that the session has of its own stays."""
    path, *_ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    key = corpus_pipeline.BATCH[0]
    spark.conf.unset(key)
    corpus_pipeline.STAGES[0][1](spark, docs, path)

    def sizes(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_pydict({"n": [b.nbytes for b in batches]})

    long = spark.range(0, 6000, 1, 1).select(F.repeat(F.lit("word "), 1000).alias("text"))
    found = [r.n for r in long.mapInArrow(sizes, "n long").collect()]
    assert sum(found) > 30_000_000 and max(found) < 9_000_000
    spark.conf.set(key, "1m")
    corpus_pipeline.STAGES[0][1](spark, docs, path)
    assert spark.conf.get(key) == "1m"
    spark.conf.unset(key)
