"""Near-duplicate classes against all pairs of shingle sets, with borderline pairs, hot groups, several blocks and the second round."""

import random

import numpy as np
import pytest

from wharfline.llm import jaccard, simhash

from .test_operators import components

WORDS = [a + b for a in ("stone", "water", "bridge", "garden", "winter", "letter", "market", "window") for b in ("", "s", "ing", "er", "ful", "less", "y", "ish")]


def shingles(text):
    words = [w.lower() for w in (text or "").split()]
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def texts_of(rng):
    say = lambda n: [rng.choice(WORDS) + str(rng.randint(0, 9)) for _ in range(n)]
    out = []
    for size in (12, 40, 120, 400):
        for _ in range(3):
            base = say(size)
            out.append(base)
            for changes in (1, 1, 2, 3, max(1, size // 45), size // 40, size // 36, size // 30):
                copy = list(base)
                for _ in range(changes):
                    copy[rng.randrange(size)] = "changed" + str(rng.randint(0, 99))
                out.append(copy)
    hot = say(90)
    for _ in range(60):
        copy = list(hot)
        for _ in range(rng.randint(1, 3)):
            copy[rng.randrange(90)] = "hot" + str(rng.randint(0, 999))
        out.append(copy)
    chain = say(60)
    for i in range(10):  # each is alike the one before
        chain = chain[3:] + say(3)
        out.append(chain)
    return [" ".join(t) for t in out] + [" ".join(say(3000)), None, "", "one", "one", "One  two", " \t"]


@pytest.mark.parametrize(("crowd", "threshold"), [(2048, 4), (7, 0)])
def test_classes_equal_all_pairs(spark, crowd, threshold, monkeypatch):
    rng = random.Random(crowd + threshold)
    texts = texts_of(rng)
    sets = [shingles(t) for t in texts]
    fps = [simhash.majority(jaccard.shingles(t or "", jaccard._WordHashes())) for t in texts]
    links = []
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            b = sets[j]
            same = len(a & b)
            alike = a == b or (a and b and (5 * same >= 4 * (len(a) + len(b) - same) or (int(fps[i]) ^ int(fps[j])).bit_count() <= threshold))
            if alike:
                links.append((i, j))
    want = components(range(len(texts)), links)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = jaccard.classes(df, threshold=threshold, crowd=crowd, bucket_bytes=20_000).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    first = {}
    for r in sorted(got, key=lambda r: r.doc_id):
        first.setdefault(r.component, r.doc_id)
    assert {r.doc_id: first[r.component] for r in got} == want
    assert len(set(want.values())) < len(texts) - 60


def test_maps_rule_out_no_alike_pair():
    rng = np.random.default_rng(3)
    for n in (3, 20, 33, 500, 5000):
        base = rng.integers(0, 2**63, n).astype(np.uint64)
        sets = [np.unique(base)]
        for share in (0.02, 0.05, 0.1, 0.11, 0.3, 0.6):
            other = base.copy()
            at = rng.random(n) < share
            other[at] = rng.integers(0, 2**63, int(at.sum())).astype(np.uint64)
            sets += [np.unique(other), np.unique(other[: max(1, int(n * (1 - share)))])]
        alike = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if jaccard._alike(sets[i], sets[j])}
        for i, j in alike:
            assert jaccard._allowed(np.array([i, j]), np.array([i, j]), np.array([len(sets[i]), len(sets[j])]), [jaccard._parity(sets[i]), jaccard._parity(sets[j])])
        if n > 100:
            far = [(0, k) for k in range(1, len(sets)) if len(np.intersect1d(sets[0], sets[k])) < 0.6 * n]
            assert far and not any(jaccard._allowed(np.array([0, 1]), np.array([0, 1]), np.array([len(sets[i]), len(sets[j])]), [jaccard._parity(sets[i]), jaccard._parity(sets[j])]) for i, j in far)


def test_links_whatever_bits_differ(spark):
    """Pairs at exactly the threshold, the sign bit among the differing ones, and pairs one bit further."""
    rng = random.Random(1)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    near, far = [], []
    for k in range(300):
        a = rng.getrandbits(64)
        for out, n in ((near, 4), (far, 5)):
            bits = rng.sample(range(63), n - 1) + [63] if k % 2 else rng.sample(range(64), n)
            x = rng.getrandbits(64) if out is far else a
            out.append((signed(x), signed(x ^ sum(1 << b for b in bits))))
    got = {frozenset((r.a, r.b)) for r in simhash.links(spark.createDataFrame([(x,) for p in near + far for x in p], "fp long").distinct(), threshold=4).collect()}
    assert got == {frozenset(p) for p in near}
    opposite = [(0,), (-1,), (0x00000000FFFFFFFF,), (-0x100000000,)]
    assert simhash.links(spark.createDataFrame(opposite, "fp long"), threshold=4).count() == 0


def test_counting_a_bucket_takes_a_few_times_its_size():
    """Which shingles of a bucket others have, and how many, in little more memory than the bucket's own."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(3)
    own = [np.unique(rng.integers(0, 1 << 62, 4000, dtype=np.uint64)) for _ in range(200)]
    own[7][:3000] = own[5][:3000]
    own[9] = own[9][:0]
    own[11][:100] = own[5][:100]
    places = [np.arange(len(t)).astype("<u2") for t in own]
    batch = pa.RecordBatch.from_pydict({"bucket": [0] * 200, "base": list(range(200)), "tokens": [t.tobytes() for t in own], "at": [p.tobytes() for p in places]})
    tracemalloc.start()
    (found,) = list(jaccard._tell(iter([batch])))
    size = sum(10 * len(t) for t in own)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = {5: [1] * 3000, 7: [1] * 3000, 11: [1] * 100}  # logarithms of two and of three
    assert found["base"] == sorted(want)
    for base, tokens, at, levels in zip(found["base"], found["tokens"], found["at"], found["levels"], strict=True):
        assert np.array_equal(np.frombuffer(tokens, np.uint64), own[base][: len(want[base])])
        assert np.frombuffer(at, "<u2").tolist() == list(range(len(want[base]))) and np.frombuffer(levels, np.uint8).tolist() == want[base]
    assert peak < 5 * size, peak / size


def test_whole_sets_meet_in_passes(spark, monkeypatch):
    """However few whole sets may meet at once, the classes are the same."""
    texts = texts_of(random.Random(7))[-77:]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    written, write = [], jaccard.materialise
    monkeypatch.setattr(jaccard, "materialise", lambda table, name: written.append(name) or write(table, name))
    found = []
    for most in (1 << 30, 40_000):
        written.clear()
        rows = jaccard.classes(df, threshold=0, pass_bytes=most).collect()
        found.append((written.count("links"), {r.doc_id: r.component for r in rows}))
    (one, whole), (several, parts) = found
    assert one == 1 and several > 1 and whole == parts and len(whole) == len(texts)
