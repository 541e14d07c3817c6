"""Operators 11 to 13 against brute force: the contract's base patterns by plain re, runs by comparing words, phrases by Counter."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wharfline.llm import phrases, pii, queries, runs

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute_base(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda d=digits: 14 <= len(d) <= 19 and luhn(d),
                "phone": lambda d=digits: 10 <= len(d) <= 15,
            }[kind]()
            if good:
                out.append((m.start(), rank, m.end(), kind))
    return [(k, s, e) for s, _, e, k in sorted(out)]


def with_luhn(rng, n):
    digits = [rng.choice("456")] + [rng.choice("0123456789") for _ in range(n - 2)]
    return next("".join(digits) + c for c in "0123456789" if luhn("".join(digits) + c))


def test_base_spans_are_those_of_the_plain_patterns():
    rng = random.Random(5)
    pieces = ["a.b@c.de", "x@y", "@", "..", "a@b.c_d@e.f.g", "é", "ü@x.y", "10.0.0.1", "1.2.3.4.5.6.7.8", "300.1.1.1", "0255.0.00.000255", "+1 (974) 555-3436", "+12", "++33 1 23 45 67 89)", "+1.", " ", "-", "--", "\n", "7", "12 34", "x", "١٢", "+0-0-0-0-0-0-0-0-0-0-", "٣.4.5.6", "𝟙"]
    for _ in range(3000):
        made = [*pieces, with_luhn(rng, rng.randint(13, 20)), " ".join(re.findall(".{1,4}", with_luhn(rng, 16))), str(rng.randint(0, 10**17))]
        text = "".join(rng.choice(made) for _ in range(rng.randint(0, 12)))
        got = [(s.kind, s.start, s.end) for s in pii.spans_of(text) if s.base]
        assert got == brute_base(text), text
    long = "a" * 300_000 + "@b.c " + "1" * 300_000 + " 1" * 100_000 + "+1" * 100_000 + "." * 100_000  # linear, whatever the run
    assert [(s.kind, s.end) for s in pii.spans_of(long) if s.base] == [("email", 300_004)]


def test_checksums():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112") and pii.luhn("0")
    assert pii.mod97("DE89370400440532013000") and pii.mod97("GB82WEST12345698765432") and not pii.mod97("DE88370400440532013000")
    assert pii.mod11_10("86095742719") and not pii.mod11_10("86095742718")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Konto DE89 3704 0044 0532 0130 00 bitte", [("iban", "DE89 3704 0044 0532 0130 00")]),
        ("DE88 3704 0044 0532 0130 00", []),  # the checksum fails
        ("code GB82WEST12345698765432.", [("iban", "GB82WEST12345698765432")]),
        ("4111 1111 1111 1111 22", [("card", "4111 1111 1111 1111")]),  # the base match is 18 digits without Luhn
        ("order no 4111 1111 1111 1111 22", []),  # a word against it
        ("call (974) 555-3436 now", [("phone", "(974) 555-3436")]),
        ("(974) 555-3436", []),  # no word for it
        ("her SSN is 123-45-6789", [("ssn", "123-45-6789")]),
        ("123-45-6789", []),
        ("part 123-45-6789 ssn", []),
        ("DNI: 12345678Z", [("dni", "12345678Z")]),
        ("DNI: 12345678A", []),
        ("Steuer-ID 86 095 742 719", [("steuer_id", "86 095 742 719")]),
        ("at 2001:db8::ff00:42:8329", [("ip", "2001:db8::ff00:42:8329")]),
        ("at 10:20:30 or ::", []),
        ("NIR 1 84 12 76 451 089 46", [("nir", "1 84 12 76 451 089 46")]),
    ],
)
def test_proposals_are_confirmed_and_weighed(text, want):
    assert [(s.kind, text[s.start : s.end]) for s in pii.spans_of(text)] == want


def test_pii_tables(spark, documents):
    rows, df = documents
    more = [(500, "mail ünï@x.y to a@b.co 🙂 a@b.co, 4111111111111111"), (500, "mail ünï@x.y to a@b.co 🙂 a@b.co, 4111111111111111"), (None, "1.2.3.4"), (502, "+1 (974) 555-3436 " + "word " * 50_000 + "+1 (974) 555-3436")]
    df = df.withColumns({"spans": F.lit("clash"), "kind": F.lit(1)}).unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    got = df.select("*", pii.spans("text").alias("found"), pii.redact("text").alias("masked"))
    assert got.columns == [*df.columns, "found", "masked"]
    for r in got.collect():
        assert [(s.kind, s.start, s.end) for s in r.found if s.base] == brute_base(r.text or "")
        assert (r.masked is None) == (r.text is None)
        if r.doc_id == 500:
            assert r.masked == "mail ünï@x.y to <EMAIL> 🙂 <EMAIL>, <CARD>" and r.spans is None
    flat = sorted((r.doc_id or -1, r.kind, r.value) for r in pii.find(df).collect())
    assert flat == sorted([(-1, "ip", "1.2.3.4")] + [(500, "card", "4111111111111111"), (500, "email", "a@b.co"), (500, "email", "a@b.co")] * 2 + [(502, "phone", "+1 (974) 555-3436")] * 2)
    assert pii.find(df.limit(0)).count() == 0


def test_pii_query(spark, documents, tmp_path):
    rows, df = documents
    more = [(600, "a@b.co +1 (974) 555-3436, 4111111111111111 and 1.2.3.4"), (600, "a@b.co"), (None, "DE89370400440532013000")]
    df.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_pii(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    want = []
    for i, text in [*((r[0], r[1]) for r in rows), *more]:
        base = brute_base(text or "")
        kinds = collections.Counter(k for k, _, _ in base)
        name = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        want.append((i, *(kinds[k] for k in PATTERNS), hashlib.sha256(name.encode()).hexdigest(), "iban:0:22" if i is None else name))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def brute_runs(words):
    out = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            n = j + q - i
            if j > i and n >= max(6, 4 * q) and not any(all(words[x] == words[x + p] for x in range(i, i + n - p)) for p in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(rng):
    words = []
    while rng.random() < 0.8:
        root = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
        words += (root * rng.randint(1, 8))[: rng.randint(1, 60)]
    return words


def test_runs_against_brute_force():
    rng = random.Random(3)
    for _ in range(400):
        docs = [some_words(rng) for _ in range(rng.randint(1, 5))]
        ends = np.cumsum([len(d) for d in docs])
        got = list(zip(*[x.tolist() for x in runs.find_runs(np.array([ord(w) for d in docs for w in d], np.int64), ends)], strict=True))
        assert got == [(int(end) - len(d) + a, n, q) for d, end in zip(docs, ends, strict=True) for a, n, q in brute_runs(d)]


def brute_runs_row(i, text, plant=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    n, g = len(words), h // 10
    if plant and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    found = brute_runs(words)
    dropped = {x for s, m, q in found for x in range(s + q, s + m)}
    top = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (i, len(found), *((*top, 1000 * top[1] // top[2]) if top else (None,) * 4), sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(w for k, w in enumerate(words) if k not in dropped)))


def test_runs_query(spark, documents, tmp_path, monkeypatch):
    rng = random.Random(9)
    rows = [(r[0], r[1]) for r in documents[0]] + [(i, " ".join(some_words(rng)) + "\n \x1c \x0b") for i in range(1000, 1150)] + [(None, "a b " * 9), (7, "same " * 7), (7, "same " * 7)]
    long = ["w%d" % (i % 5000) for i in range(30_000)]
    df = spark.createDataFrame([*rows, (5, " ".join(long))], "doc_id long, text string").withColumns({"runs": F.lit("clash"), "n": F.lit(1), "h": F.lit("x")})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    want = [brute_runs_row(i, t) for i, t in rows]
    assert [g for g in got if g[3] != 30_000] == sorted(want, key=str)
    assert [g[:6] for g in got if g[3] == 30_000] == [(5, 1, 0, 30_000, 5000, 6000)]
    assert sum(w[1] for w in want) > 100
    flat = runs.find(df.filter("doc_id = 7 and text like 'same%'")).collect()
    assert [tuple(r) for r in flat] == [(7, 0, 7, 1)] * 2 and runs.find(df.limit(0)).count() == 0
    monkeypatch.setattr(runs, "WORDS", 5)
    assert [r.as_py()["collapsed"] for r in runs._analysed(__import__("pyarrow").array(["a b a b a b a b", None, "x", " ", "b b b b b b c"]))] == ["a b", "", "x", "", "b c"]


def brute_phrases(rows, most, least, top, contained):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, most + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        held = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = collections.Counter()
        for p, a in held.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        scored = []
        for p, a in held.items():
            if p not in inside or 100 * inside[p] < contained * a:
                s, _, left, right = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                scored.append((-s, -a, " ".join(p).encode(), left, right))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [4 << 20, 300])
@pytest.mark.parametrize(("most", "least", "top", "contained"), [(3, 2, 2000, 50), (2, 1, 7, 100), (4, 2, 2000, 50)])
def test_phrases_against_brute_force(spark, documents, monkeypatch, most, least, top, contained, block):
    monkeypatch.setattr(phrases, "BUCKET", 500)  # several buckets
    monkeypatch.setattr(phrases, "BLOCK", block)
    rows, df = documents
    rng = random.Random(2)
    more = [("en", "To be, or not\tto  be! To be\rthat\x0bis . the;Question "), ("en", "ÄB äb c\x1cd " * 20), (None, "to be or not to be " * 30), ("x", "a " * 2000), ("x", ", ,,"), ("en", " ".join(rng.choice("abcdefgh") for _ in range(3000)))] * 2
    df = df.withColumn("chunk", F.lit("clash")).withColumn("n", F.lit(1)).unionByName(spark.createDataFrame(more, "lang string, text string"), allowMissingColumns=True)
    got = phrases.mine(df, most=most, least=least, top=top, contained=contained)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and all(t == "bigint" for c, t in got.dtypes if c not in ("lang", "phrase"))
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases([(r[2], r[1]) for r in rows] + more, most, least, top, contained)


def test_parsing_is_free_of_prefixes_and_covers_once():
    """The same words are cut alike wherever they stand, and each phrase begins in one chunk that holds it whole."""
    rng = random.Random(4)
    words = [rng.choice("abcdefghijklmnop") + str(rng.randint(0, 9)) for _ in range(400)]
    text = " ".join(words)
    parsed = phrases.Parsed((text + "\n\n  one \n" + text).encode())
    some = phrases.Parsed(b" a \r\r  b c\rd\n\re ")
    assert some.text == b" a \rb c\rd\n\re " and some.piece.tolist() == [0, 1, 1, 2, 4] and some.line.tolist() == [0, 0, 0, 0, 1]
    first, end, last = phrases.cuts(parsed, 2, 8)
    seen = np.zeros(len(parsed.starts), int)
    for s, e, is_last in zip(first, end, last, strict=True):
        seen[s : e if is_last else e - 2] += 1
    assert (seen == 1).all() and last.sum() == 3 and len(first) > 20
    chunks = [parsed.text[parsed.starts[s] : parsed.ends[e - 1]] for s, e in zip(first, end, strict=True)]
    half = (len(chunks) - 1) // 2
    assert chunks[:half] == chunks[half + 1 :] and chunks[half] == b"one"


def test_phrases_of_nothing(spark):
    assert phrases.mine(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert phrases.mine(spark.createDataFrame([(None, None), ("en", " .. ")], "lang string, text string")).count() == 0


def test_phrase_scores_beyond_64_bits(spark):
    counts = spark.createDataFrame([("en", 1, "a", 3 * 10**12), ("en", 1, "b", 2 * 10**12 + 1), ("en", 2, "a b", 10**12 + 7)], "lang string, size int, phrase string, n long")
    got = phrases.collocations(counts).first()
    assert got.score == 10**6 * (10**12 + 7) ** 2 // (3 * 10**12 * (2 * 10**12 + 1))
