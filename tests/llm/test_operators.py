"""Each operator against a brute-force version on a small fixture, with nulls, blanks, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from wharfline.llm import decontam, graph, langid, lmscore, mtree, packing, quality, simhash, suffix, urls, warc


def components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        parent[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for n in nodes:
        groups[find(n)].append(n)
    return {n: min(g) for g in groups.values() for n in g}


def test_backoff_by_hand():
    """Posteriors by plain dictionaries: words first, else the longest n-grams that are known."""
    texts = {"en": ["the water was there", "and of this water"], "de": ["der apfel ist über das wasser", "wasser ist da"], "fr": ["la mer est là"]}
    model_rows = []
    for lang, own in texts.items():
        words = collections.Counter(w for t in own for w in langid.words_of(t))
        model_rows += [(0, w, lang, c) for w, c in words.items()]
        for n in range(1, 6):
            model_rows += [(n, g, lang, c) for g, c in collections.Counter(g for w, k in words.items() for g in [f"<{w}>"[i : i + n] for i in range(len(w) + 3 - n)] * k).items()]
    langs = sorted(texts)
    model = langid.Backoff(langs, model_rows)

    def evidence(n, gram):
        table = {g for k, g, _, _ in model_rows if k == n}
        if gram not in table:
            return None
        p = [(sum(c for k, g, lang, c in model_rows if (k, g, lang) == (n, gram, x)) + 0.5) / (sum(c for k, _, lang, c in model_rows if (k, lang) == (n, x)) + 1 + 0.5 * len(table)) for x in langs]
        return [math.log(x / sum(p)) for x in p]

    for text in ("the wasser was", "wässrig mere", "qq", "x y z", "Water, WASSER! la", "there " * 50 + "ist"):
        total = [0.0] * len(langs)
        for w in langid.words_of(text):
            found = evidence(0, w)
            for n in range(5, 0, -1):
                if found is None and len(w) + 2 >= n:
                    known = [e for i in range(len(w) + 3 - n) if (e := evidence(n, f"<{w}>"[i : i + n])) is not None]
                    found = [sum(x) / len(known) for x in zip(*known, strict=True)] if known else None
            total = [a + b for a, b in zip(total, found or [0.0] * len(langs), strict=True)]
        top = max(total)
        p = [math.exp(x - top) for x in total]
        lang, score = model.predict(text)
        assert lang == langs[p.index(max(p))] and abs(score - max(p) / sum(p)) < 1e-9, text


def test_embeddings_by_hand():
    """The score by plain loops over tokens, their character n-grams and bigrams."""
    model = quality.Embeddings(dim=4, seed=3)
    rng = np.random.default_rng(4)
    model.layer, model.bias = rng.normal(size=(4, 2)).astype(np.float32) * 20, np.array([0.3, -0.2], np.float32)

    def spread(h):
        return ((h ^ (h >> 15)) * 0x85EBCA6B & 0xFFFFFFFF) >> (32 - quality.BUCKET_BITS)

    for text in ("a bb a <repeat> ccc ccc", "x", "ünï ✓ token " * 30, "same same same", "<repeat> <repeat>"):
        words, used = text.split(), []
        for w in words:
            used.append(spread(zlib.crc32(w.encode())))
            for n in (3, 4):
                for i in range(len(w) + 3 - n):
                    h = n
                    for c in f"<{w}>"[i : i + n]:
                        h = (h * 0x01000193 + ord(c)) & 0xFFFFFFFF
                    used.append(spread(h))
        for a, b in zip(words, words[1:], strict=False):
            used.append(quality.REPEAT if a == b else spread((zlib.crc32(a.encode()) * 0x9E3779B1 + zlib.crc32(b.encode())) & 0xFFFFFFFF))
        mean = sum(model.vectors[u].astype(float) for u in used) / len(used)
        z = mean @ model.layer + model.bias
        assert abs(model.score(text) - 1 / (1 + math.exp(z[0] - z[1]))) < 1e-5, text
        example = next(quality._examples(iter([pa.RecordBatch.from_pydict({"label": [1], "text": [text]})])))
        want = collections.Counter(used)
        assert np.frombuffer(example["at"][0], "<i4").tolist() == sorted(want)
        assert np.allclose(np.frombuffer(example["weights"][0], "<f4"), [want[u] / len(used) for u in sorted(want)])


def test_samples_are_drawn_by_row(spark):
    from wharfline.llm.shared import bounded_sample

    df = spark.createDataFrame([(None, "same")] * 10_000, "key long, text string")
    assert 250 < bounded_sample(df, 400).count() < 600 and bounded_sample(df, 20_000).count() == 10_000


def test_language_id(spark, documents):
    rows, df = documents
    known = spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate([("the water was there and of this", "en"), ("der apfel ist groß und über das wasser", "de")] * 5)], "doc_id long, text string, lang string")
    model = langid.train(known)
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert len(got) == len(rows) and langid.identify(df, model).columns == ["doc_id", "text", "lang", "source", "lang_pred", "score"]
    for i, text, *_ in rows:
        has = bool(text) and any(c.isalpha() for c in text)
        assert (got[i].lang_pred == "und") == (not has), text
        assert 0 <= got[i].score <= 1
    assert got[next(i for i, t, *_ in rows if t and t.startswith("Äpfel"))].lang_pred == "de"
    assert model.predict("wasser")[0] == "de" and model.predict("wasserg")[0] == "de"  # unseen: by n-grams
    assert langid.identify(df.limit(0), model).count() == 0
    assert langid.train(known.limit(0)).predict("any") == ("und", 0.0)


def test_quality(spark):
    good = ["a plain sentence of words number %d here" % i for i in range(60)]
    bad = ["win### cash$$$ now*** number%d!!" % i for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)] + [(1000, None), (1001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(100) if i % 5] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert all((got[i] >= 0.3) == (i < 60) for i in range(0, 100, 5))
    assert got[1000] == got[1001] and 0 < got[1000] < 1
    assert quality.score(docs.limit(0), model).count() == 0


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, documents):
    rows, df = documents
    df = df.union(df.filter("doc_id = 2"))
    got = simhash.near_duplicates(df).collect()
    fps = {i: brute_fingerprint(t or "") for i, t, *_ in rows}
    linked = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4]
    want = components(fps, linked)
    assert len(got) == len(rows) + 1
    assert {(r.doc_id, r.fp % (1 << 64), r.component_id) for r in got} == {(i, fps[i], want[i]) for i in fps}
    assert len(set(want.values())) < len(rows) - 20
    named = df.select(F.concat(F.lit("d"), F.lpad("doc_id", 3, "0")).alias("doc_id"), "text", F.lit("clash").alias("fp")).union(spark.createDataFrame([("z", "long word " * 20_000, "")], "doc_id string, text string, fp string"))
    assert {(r.doc_id, r.component_id) for r in simhash.near_duplicates(named).collect()} == {(f"d{i:03}", f"d{want[i]:03}") for i in fps} | {("z", "z")}
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("threshold", [2, 4])
def test_anchors_cover(threshold):
    rng = np.random.default_rng(threshold)
    p = rng.integers(-(2**63), 2**63 - 1, 500)
    q = p.copy()
    for i in range(len(q)):
        for b in rng.choice(64, threshold, replace=False):
            q[i] ^= np.uint64(1 << int(b)).astype(np.int64)
    code = simhash.AnchorCode(threshold)
    homes = code.homes(p)
    row, anchor, _ = code.near(q)
    reached = set(zip(row.tolist(), anchor.tolist(), strict=True))
    assert all({(i, int(homes[0][i])), (i, int(homes[1][i]))} & reached for i in range(len(p)))


def test_links_with_crowded_anchors(spark):
    """Fingerprints in one ball: homes are dealt to several buckets, and no link is lost."""
    fps = [0, *[1 << b for b in range(20)], *[(1 << b) | (1 << (b + 30)) for b in range(20)], 0xFFFF << 40, (0xFFFF << 40) | 7]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for at_once in (4096, 2):
        got = components(fps, [(r.a, r.b) for r in simhash.links(df, homes_at_once=at_once, bucket_rows=50).collect()])
        assert got == components(fps, [(a, b) for a in fps for b in fps if 0 < (a ^ b).bit_count() <= 4])


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, x) for x in range(101, 120)] + [(200, 200), (None, 5), (301, 300), (301, 300)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 31)}, **{i: 100 for i in range(100, 120)}, 300: 300, 301: 300}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_urls(spark):
    rows = [
        (1, "http://a.org/x/y?q=1#f", '<LINK REL="canonical" HREF="/canon">'), (2, "https://A.org/canon", None), (3, "http://a.org/x/z", '<meta http-equiv="refresh" content="0; URL=http://bad.example.com/en/1">'), (4, "http://a.org/x/w", "<link rel=canonical href=z>"),
        (5, None, "x"), (6, "nourl", ""), (7, "http://www.example.com/en/9", '<link rel="canonical" href="http://c.org">'), (8, "http://c.org", ""), (9, "http://bad.example.com/en/7", '<link href="//c.org" rel="canonical">'), (9, "http://bad.example.com/en/7", ""), (10, "http://notexample.com/en/1?x", "<link rel=canonical href='http://['>"),
    ]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string").withColumns({c: F.lit("clash") for c in ("host", "decision", "_node", "_spread", "node", "page", "component")})
    rules = spark.createDataFrame([("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), (None, "allow"), ("x/", None)], "rule string, decision string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, rules, urls.link_edges(pages)).collect())
    assert got == sorted(
        [
            (1, "a.org", "/x/y", None, "allow"), (2, "a.org", "/canon", None, "allow"), (3, "a.org", "/x/z", None, "block"), (4, "a.org", "/x/w", None, "block"), (5, "", "", None, "allow"), (6, "", "", None, "allow"),
            (7, "www.example.com", "/en/9", "www.example.com/en/", "allow"), (8, "c.org", "", None, "allow"), (9, "bad.example.com", "/en/7", "example.com/en/", "block"), (9, "bad.example.com", "/en/7", "example.com/en/", "block"), (10, "notexample.com", "/en/1", "com/", "allow"),
        ]
    )
    places = [("1.b", "/xx"), ("1.b", "/xy/" + "z" * 6000), ("2.b", "/xy"), ("b", "/x")]
    found = {(r.host, r.path): (r.rule, r.decision) for r in urls.match_rules(spark.createDataFrame(places * 2, "host string, path string"), spark.createDataFrame([("1.b/", "block"), ("b/xx", "block"), ("b/x", "allow"), ("b/y", "allow"), ("1.b/xy/" + "z" * 5000, "allow")], "rule string, decision string")).collect()}
    assert found == {places[0]: ("1.b/", "block"), places[1]: ("1.b/xy/" + "z" * 5000, "allow"), places[2]: ("b/x", "allow"), places[3]: ("b/x", "allow")}
    assert set(urls.judge(pages, rules, urls.link_edges(pages)).columns) == {*pages.columns, "path", "rule", "verdict"}
    assert urls.judge(pages.limit(0), rules.limit(0), urls.link_edges(pages.limit(0))).count() == 0


def brute_leaks(docs, items, theta=0.6, overlap=0.8):
    """Every item against every passage: BM25 by its formula, shingles by sets."""
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    items = [(i, t, words(t)) for i, t in items if i is not None and words(t)]
    longest, mean = max(len(w) for *_, w in items), sum(len(w) for *_, w in items) / len(items)
    df = collections.Counter(t for *_, w in items for t in set(w))
    out = {}
    for doc, text in docs:
        every = words(text)
        for i, t, w in items:
            group = int(math.log(longest / len(w), 4) + 1e-9)
            step = longest // 4**group
            impact = {x: math.log(1 + (len(items) - df[x] + 0.5) / (df[x] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(w) / mean)) for x, n in collections.Counter(w).items()}
            q, a = decontam.question_and_answer(t)
            for at in range(0, max(1, len(every) - step), step):
                passage = every[at : at + 2 * step]
                score = sum(x for y, x in impact.items() if y in passage) / sum(impact.values())
                held = [1.0 if not s else len(s & decontam.shingles(passage, len(next(iter(s))))) / len(s) for s in (decontam.shingles(q), decontam.shingles(a))]
                if score >= theta - 1e-6 and min(held) >= overlap:
                    out[doc, i] = max(out.get((doc, i), 0.0), score)
    return out


def test_decontamination(spark, documents):
    rows, df = documents
    item = "Which water was there first of all these? The answer is the old stone bridge over there."
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "one two three"), (5, item), (None, item)], "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    planted = df.select("doc_id", "text").union(spark.createDataFrame([(900, "before " * 300 + item.upper() + " after" * 30_000), (901, "Which water was there first of all these? Nobody knows."), (902, "x one two three y"), (903, item), (903, item), (None, item)], "doc_id long, text string")).withColumns({"score": F.lit("clash"), "item_id": F.lit("clash")})
    found = decontam.find(planted, items).collect()
    got = {(r.doc_id, r.item_id): r.score for r in found}
    assert set(got) == {(900, 1), (900, 5), (902, 4), (903, 1), (903, 5), (None, 1), (None, 5)} and len(found) == 9
    assert all(math.isclose(s, 1.0, abs_tol=1e-6) for s in got.values())
    assert {(r.doc_id, r.item_id): round(r.score, 9) for r in decontam.find(planted, items, index_bytes=90).collect()}.keys() == got.keys()
    assert decontam.find(df.limit(0), items).count() == 0 and decontam.find(df, items.limit(0)).count() == 0


def test_decontamination_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, f"{say(int(rng.integers(3, 30)))}? {say(int(rng.integers(1, 20)))}." if i % 3 else say(int(rng.integers(1, 9)))) for i in range(60)]
    docs = []
    for i in range(80):
        part = items[i % 60][1].split()
        for _ in range(i % 7):
            part[int(rng.integers(len(part)))] = say(1)
        docs.append((i, f"{say(int(rng.integers(0, 150)))} {' '.join(part)} {say(int(rng.integers(0, 150)))}"))
    want = brute_leaks(docs, items)
    assert 30 < len(want)
    for index_bytes in (4 << 20, 700):
        got = {(r.doc_id, r.item_id): r.score for r in decontam.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), index_bytes=index_bytes).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in got)


def test_wand_equals_exhaustive():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(60)]
    index = decontam.Index([(i, " ".join(rng.choice(vocabulary, rng.integers(3, 15)))) for i in range(90)])
    skipped = 0
    for _ in range(40):
        terms = set(rng.choice(vocabulary, 20).tolist()) & index.number.keys()
        for theta in (0.3, 0.6, 0.9):
            scores = collections.Counter()
            for t in terms:
                for i, x in zip(*index.postings[t], strict=True):
                    scores[i] += x
            want = {i for i, s in scores.items() if s >= theta}
            assert {i for i, _ in index.retrieve(terms, theta)} == want
            open_ = set(index.open_blocks(terms, theta).tolist())
            assert {i // decontam.BLOCK for i in want} <= open_
            skipped += index.n_blocks - len(open_)
    assert skipped


def test_packing(spark, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows, df = documents
    for targets in (None, {"s1": 0.7, "s2": 0.3}):
        got = packing.pack(df.repartition(3), path, length=256, targets=targets).collect()
        pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
        for r in got:
            pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
            sequences[r.sequence_id].append((r.offset, r.length))
        for i, text, *_ in rows:
            ids, at = tokenizer.encode(text or "", add_special_tokens=False).ids + [1], 0
            for start, n, crc, total in sorted(pieces[i]):
                assert (start, total, crc) == (at, len(ids), zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()))
                at += n
            assert at == len(ids)
        for v in sequences.values():
            at = 0
            for offset, n in sorted(v):
                assert offset == at
                at += n
            assert at == 256 or at & (at - 1) == 0
        assert sorted(sequences) == list(range(len(sequences)))
    assert packing.pack(df.limit(0), path).count() == packing.pack(df.limit(0), path, targets={"s1": 1.0}).count() == 0


def test_packing_of_many_sources(spark):
    """More sources than queues: each keeps its share, a small one up to a document; nulls, repeated rows, other tokenizers."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = [(i, f"text {i} of It's Ours", f"s{i % 400}" if i % 3 else "hot") for i in range(4000)] + [(None, None, None), (7, "again", "s7"), (7, "again", "s7")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"row": F.lit("clash"), "first": F.lit("clash"), "queue": F.lit("clash")})
    got = packing.pack(df.repartition(3), path, length=64).collect()
    at, used = collections.defaultdict(int), collections.defaultdict(collections.Counter)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
        used[r.sequence_id][r.source] += r.length
    lengths = collections.Counter()
    for i, t, _ in rows:
        lengths[i] += len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
    assert {i: sum(r.length for r in got if r.doc_id == i) for i in {7, None}} == {7: lengths[7], None: 1}
    assert sum(r.length for r in got) == sum(lengths.values())
    total, done = collections.Counter(), collections.Counter()
    for w in used.values():
        total.update(w)
    longest = max(lengths.values())
    full = [w for w in sorted(used) if at[w] == 64]
    for n, w in enumerate(full, 1):
        done.update(used[w])
        for s in total:
            due = total[s] * n * 64 / sum(total.values())
            assert abs(done[s] - due) <= (1 if s == "hot" else 3 * longest), (s, n)
    few = packing.pack(df, path, length=64, targets={"hot": 1.0, "s1": 0.5, "s2": 0.001, "absent": 0.5}).collect()
    assert sum(r.length for r in few) == sum(lengths.values())


def test_windows_keep_the_mixture():
    totals = [50_000, 30_000, 20_000]
    placer = packing.Placer(totals, None, 100)
    used = np.zeros((placer.windows, 3))
    for q, n in enumerate(totals):
        for _, _, size, window, _ in placer.pieces(q, np.array([0]), np.array([n])):
            inside = window < placer.windows
            np.add.at(used[:, q], window[inside], size[inside])
    assert (np.abs(np.cumsum(used, axis=0) - np.outer(np.arange(1, placer.windows + 1), [50, 30, 20])) <= 1).all()


def test_words_encode_like_whole_texts():
    import public_tokenizers

    encoder = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    for x in ["", "a'b don't I'M", "x\x1cy z", "<|endoftext|> hi<|startoftext|>there", "ÀÉß ÿ ǅ İ", "12,000.50 ..., !!a", "é x", "日本語 テキスト", "Σας ΟΔΟΣ nb ls\x85k", "***bold$$$ a.b.c, A.", "a, b,\nc; d: e., f.\t g,", "'T. 'll, x's."]:
        assert encoder.encode([x])[0].tolist() == encoder.tokenizer.encode(x, add_special_tokens=False).ids, x
    assert packing.goes_by_words(public_tokenizers.path("word_bpe_49k.json")) and not packing.goes_by_words(public_tokenizers.path("byte_bpe_50k.json"))


def test_added_tokens_count_in_their_own_case_only():
    """Texts are put in lower case; that must not make an added token of what is none."""
    from wharfline.llm.queries import tokenizer_path

    encoder = packing.WordEncoder(tokenizer_path())
    for x in ["<|ENDOFTEXT|> A", "Hi<|StartOfText|>x", "b <|endoftext|>, C", "Straße!! ÉTÉ's a*b 5'S A1b2c."]:
        assert encoder.encode([x])[0].tolist() == encoder.tokenizer.encode(x, add_special_tokens=False).ids, x


def test_words_of_small_letters_need_no_normalizer():
    """They go to the model alone, each once; the whole tokenizer costs twice as much a word."""
    from wharfline.llm.queries import tokenizer_path

    encoder = packing.WordEncoder(tokenizer_path())
    text, whole, seen = "Gruß an été, naïve words; a b.", encoder.tokenizer, []

    class Counted:
        def encode(self, text, **options):
            seen.extend(text.split())
            return whole.encode(text, **options)

        def encode_batch_fast(self, texts, **options):
            seen.extend(texts)
            return whole.encode_batch_fast(texts, **options)

    encoder.tokenizer = Counted()
    for _ in range(2):
        assert encoder.encode([text, ""])[0].tolist() == whole.encode(text, add_special_tokens=False).ids
    assert seen and len(seen) == len(set(seen)) and not any(map(str.isalpha, seen))


def test_packing_of_long_texts(spark):
    """Texts that end one chunk and begin another, nulls between them: each once, whole."""
    from wharfline.llm.queries import tokenizer_path

    tokenizer = packing.WordEncoder(tokenizer_path()).tokenizer
    texts = ["Some words of it. " * (packing.CHUNK // 30), None, "und noch eins, " * (packing.CHUNK // 12), "", "x", "the\x1cend " * 1000, "last one " * (packing.CHUNK // 20)]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").coalesce(1)
    got = collections.defaultdict(list)
    for r in packing.pack(df, tokenizer_path(), keep_ids=True).collect():
        got[r.doc_id].append((r.start, r.ids))
    for i, t in enumerate(texts):
        assert b"".join(x for _, x in sorted(got[i])) == np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes(), i


def test_top_k(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), v) for i, v in enumerate(rng.integers(-60, 60, (400, 8)).tolist())]
    rows += [(500, rows[0][1]), (501, rows[0][1]), (502, [1, 2]), (503, None), (504, [None] * 8), (None, rows[1][1]), (505, [3, 4])]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>").withColumns({"tree": F.lit("clash"), "part": F.lit(9), "data": F.lit("clash")})
    got = [tuple(r) for r in mtree.top_k(df, df.filter("vec_id % 50 = 0 or vec_id = 502"), k=5, tree_rows=100, query_rows=4).collect()]
    usable = [(i, v) for i, v in rows if i is not None and v and None not in v]
    want = []
    for q, v in usable:
        if q % 50 == 0 or q == 502:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in usable if i != q and len(w) == len(v))
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored[:5])]
    assert sorted(got) == sorted(want)
    assert mtree.top_k(df.limit(0), df.limit(0)).count() == 0


def test_tree_prunes():
    rng = np.random.default_rng(1)
    centres = rng.integers(-1000, 1000, (20, 6))
    points = (centres[rng.integers(0, 20, 5000)] + rng.integers(-5, 6, (5000, 6))).astype(np.int64)
    tree = mtree.MTree(np.arange(5000), points)
    seen, plain = [], tree._products
    tree._products = lambda asked, rows: seen.append(len(asked) * len(rows)) or plain(asked, rows)
    asked = np.arange(0, 5000, 100)
    row, score, vec = tree.search(points[asked], asked, 5)
    for at, q in enumerate(asked.tolist()):
        best = sorted(((-int(x), int(i)) for i, x in enumerate(points @ points[q]) if i != q))[:5]
        assert [(-s, i) for s, i in zip(score[row == at].tolist(), vec[row == at].tolist(), strict=True)] == best
    assert sum(seen) < 5000 * len(asked) * 0.8


def first_like(records, block):
    return records.filter("target_uri = 'http://a.org/' and record_type = 'response'").select(*warc.FIELDS, F.lit(block).alias("block"))


def test_warc(spark, tmp_path):
    html = '<html><head><title>A &amp; B</title><style>x</style><script>var t="</p>";</script></head><body><p>One<br>two &lt;three&gt;</p><!-- no --><div>  four </div></body></html>'
    pages = spark.createDataFrame([(1, "http://a.org/", html), (2, None, None), (3, "http://b.org/", "plain\r\n\r\ntext"), (3, "http://b.org/", "plain\r\n\r\ntext")], "page_id int, url string, html string")
    source = warc.responses(pages.withColumns({c: F.lit("clash") for c in ("_cut", "_head", "_body", "_text", "cut", "head", "other", "read")}))
    made = {(r.page_id, r.record_type): r for r in warc.derive(source).collect()}
    assert len(made) == 6 and warc.derive(source).count() == 8
    first = source.filter("page_id = 1").first()
    text, meta = made[1, "conversion"], made[1, "metadata"]
    assert text.block == "A & B\nOne\ntwo <three>\nfour"
    assert text.refers_to == meta.refers_to == first.record_id and text.target_uri == "http://a.org/"
    assert text.block_digest == "sha256:" + hashlib.sha256(text.block.encode()).hexdigest()
    lines = meta.block.split("\r\n")
    assert lines[0] == "http-status: 200" and "http-content-type: text/html; charset=utf-8" in lines and f"source-payload-digest: {first.payload_digest}" in lines and "title: A & B" in lines
    assert made[2, "conversion"].block == "" and made[3, "conversion"].block == "plain\ntext"
    every = source.select(*[c for c in source.columns if c != "page_id"]).unionByName(warc.derive(source).select(*[c for c in source.columns if c != "page_id"]))
    every = every.select(*warc.FIELDS, "block").unionByName(first_like(every, "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nb ü\r\n\r\n"))
    for compression in ("none", "gzip"):
        path = str(tmp_path / compression)
        warc.write(every, path, compression=compression)
        back = warc.read(spark, path)
        key = lambda rows: sorted((r.record_id, r.record_type, r.refers_to or "", r.target_uri or "", r.block) for r in rows)
        assert key(back.collect()) == key(every.collect())
        assert back.filter("octet_length(block) <> content_length").count() == 0
    assert warc.derive(source.limit(0)).count() == 0


def test_warc_files_of_others(spark, tmp_path):
    """A member for each record, binary blocks, a record without a length, fields in any case."""
    records = [b"WARC/1.0\r\nwarc-type: resource\r\nWARC-Record-ID: <urn:x:1>\r\nContent-Length: 4\r\n\r\n\xff\x00\r\n\r\n\r\n", b"WARC/1.1\r\nWARC-Type: warcinfo\r\n\r\n\r\n\r\n", b"WARC/1.1\nWARC-Type: metadata\nContent-Length: 3\n\nabc\r\n\r\n"]
    import gzip

    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "b.warc").write_bytes(b"".join(records))
    (tmp_path / "empty.warc").write_bytes(b"")
    got = sorted((r.record_type, r.record_id or "", r.content_length, bytes(r.content)) for r in warc.read(spark, str(tmp_path)).collect())
    assert got == sorted([("resource", "<urn:x:1>", 4, b"\xff\x00\r\n"), ("warcinfo", "", 0, b""), ("metadata", "", 3, b"abc")] * 2)


def test_plain_text():
    assert warc.plain_text("It&#8217;s caf&eacute; &#x27;x&#x27; &amp;lt; &euro;5&nbsp;&nbsp;a<b<br>c&hellip;</p> <!-- <p> -->d<SCRIPT>&amp;</SCRIPT >e &unknown;") == "It\u2019s café 'x' &lt; €5 ac\u2026\nd e &unknown;"
    assert warc.plain_text("1 < 2 &#233;<td>x</td>" + "y" * 100_000 + "<i>z</i>") == "1 < 2 é\nx\n" + "y" * 100_000 + "z"
    assert warc.title_of("<TITLE a=b> A\n&ldquo;B&rdquo; <b>c</b></title>") == "A \u201cB\u201d c" and warc.title_of("") == ""


def brute_repeats(rows, length=50):
    first = {}
    for i, t in sorted(r for r in rows if r[0] is not None):
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        cover = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if i is not None and first[b[p : p + length]] < i:
                cover[p : p + length] = True
        kept = np.frombuffer(b, np.uint8)[~cover].tobytes()
        out.append((i, len(b), int(cover.sum()), int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("crowd", [50_000, 2])
def test_repeats(spark, documents, crowd):
    rows, df = documents
    plain = [(i, t) for i, t, *_ in rows]
    plain += [plain[3], (3, "another text under the same number that is long enough to be looked at, is it not?"), (None, plain[0][1])]
    df = spark.createDataFrame(plain, "doc_id long, text string").withColumn("kept", F.lit(1))
    got = sorted((tuple(r) for r in suffix.find_repeats(df, crowd=crowd, bucket_bytes=2000).drop("kept").collect()), key=str)
    assert got == brute_repeats(plain)
    assert suffix.find_repeats(df.limit(0)).count() == 0
    assert suffix.find_repeats(df.filter("length(text) < 40 or text is null")).filter("n_removed > 0").count() == 0


def test_previous_factors():
    """Value by value: the longest prefix that a suffix shares with one of a smaller document."""
    rng = np.random.default_rng(2)
    suffixes = rng.integers(97, 99, (200, 9)).astype(np.uint8)
    docs = rng.integers(0, 30, 200)
    common = lambda a, b: next((i for i in range(9) if a[i] != b[i]), 9)
    want = [max((common(suffixes[j], suffixes[i]) for j in range(200) if docs[j] < docs[i]), default=0) for i in range(200)]
    assert suffix.previous_factors(suffixes, docs, 9).tolist() == want
    assert len(set(want)) > 4


def test_repeats_by_ids_of_text(spark):
    """Ids of text by their order, long texts, whole characters, a clashing column."""
    passage = "Über die Brücke ging früher täglich ein ältlicher Müller mit Säcken, "
    plain = [("b", passage + "äöü" * 40), ("a", "x" + passage), ("c", "word " * 30_000 + passage), (None, passage), ("d", None)]
    df = spark.createDataFrame(plain, "doc_id string, text string").withColumn("number", F.lit("clash"))
    got = {r.doc_id: r for r in suffix.find_repeats(df, whole_characters=True, carry=["number"]).collect()}
    want = {i: rest for i, *rest in brute_repeats([({"a": 0, "b": 1, "c": 2, "d": 3}.get(i), t) for i, t in plain])}
    for name, at in (("a", 0), ("b", 1), ("c", 2), ("d", 3), (None, None)):
        assert [got[name].n_bytes, got[name].n_removed, got[name].n_spans, got[name].kept_sha256] == want[at]
    assert got["b"].n_removed > 50 and got["b"].carried.number == "clash" and got["b"].kept.decode()


def test_lm_scores(spark, documents):
    """Against dictionaries, by each route of a bigram; keys of text, long texts, repeated rows and rows without a key."""
    rows, df = documents
    talk = ["the water was there", "which water", None, "", "THE Water was\tthere"]
    target = spark.createDataFrame([(t,) for t in talk], "text string")
    df = df.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id"))).withColumns({"n": F.lit("clash"), "id": F.lit("clash"), "side": F.lit(9)})
    more = [("long", "rare%d words " * 3000 % tuple(range(3000))), ("d3", rows[3][1]), (None, rows[4][1])]
    df = df.unionByName(spark.createDataFrame(more, "doc_id string, text string"), allowMissingColumns=True)
    texts = [*(r[1] for r in rows), *(t for _, t in more)]
    ids = lambda t: ["<s>", *(t or "").lower().split(), "</s>"]
    types = len({w for t in texts + talk for w in ids(t)}) - 1

    def model(texts):
        one, two = collections.Counter(), collections.Counter()
        for t in texts:
            x = ids(t)
            one.update(x)
            two.update(zip(x, x[1:], strict=False))
        total = sum(n for w, n in one.items() if w != "<s>")

        def loss(x):
            return -sum(math.log((two[a, b] + 100 * (one[b] + 1) / (total + types)) / (one[a] + 100)) for a, b in zip(x, x[1:], strict=False)) / (len(x) - 1)

        return loss

    near, far = model(talk), model(texts)
    want = sorted((str(k), len(ids(t)) - 1, near(ids(t)), far(ids(t))) for k, t in [*((f"d{r[0]}", r[1]) for r in rows), *more])
    for listed, sample in ((20, 4000), (0, 2)):
        got = sorted((str(r.doc_id), r.n_tokens, r.loss_target, r.loss_background, r.score) for r in lmscore.score(df, target, listed=listed, sample=sample, bucket_bytes=80_000).collect())
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert all(abs(g[2] - w[2]) < 2e-6 and abs(g[3] - w[3]) < 2e-6 and abs(g[4] - g[2] + g[3]) < 1e-9 for g, w in zip(got, want, strict=True))
    assert lmscore.score(df.limit(0), target).count() == 0
    empty = lmscore.score(df.limit(5), target.limit(0)).collect()
    assert len(empty) == 5


def test_lm_counts_see_every_word(spark):
    """Rare words keep counts of their own: a text that occurs twice is likelier under the background than one that occurs once."""
    words = [f"word{i}" for i in range(20_000)]
    texts = [" ".join(words[i : i + 20]) for i in range(0, 20_000, 20)]
    df = spark.createDataFrame([*enumerate(texts), (5000, texts[0])], "doc_id long, text string")
    got = {r.doc_id: r.loss_background for r in lmscore.score(df, df.limit(0), listed=100).collect()}
    assert got[0] == got[5000] < min(v for i, v in got.items() if i not in (0, 5000))


def test_packing_keeps_no_words_after_a_task(spark, documents):
    """A Python worker goes on to other stages; the words that a task has met don't stay in it."""
    from wharfline.llm.queries import tokenizer_path

    packing.pack(documents[1], tokenizer_path()).count()

    def held(batches):
        list(batches)
        yield pa.RecordBatch.from_pydict({"n": pa.array([len(e.words) for e in packing._encoders.values() if isinstance(e, packing.WordEncoder)], pa.int64())})

    found = [r.n for r in spark.range(0, 64, 1, 16).mapInArrow(held, "n long").collect()]
    assert found and not any(found)
