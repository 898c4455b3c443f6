"""Repeated windows against a brute count of word tuples, with every bucket whole and every bucket dealt in parts."""
import hashlib
import random
from collections import Counter

import pytest

import __spark_entry__ as ent
from oracle_check import compare, duck
from tessera.llm import substrings
from test_operators import frame


def plain(rows, k):
    words = [(t or "").encode().split() for _, t, *_ in rows]
    seen = Counter(tuple(w[i:i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for (i, *_), w in zip(rows, words):
        gone = set()
        for at in range(len(w) - k + 1):
            if seen[tuple(w[at:at + k])] > 1:
                gone.update(range(at, at + k))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        spans = [(a, b) for a, b in stretches(sorted(gone))]
        out.append((i, len(w), len(gone), tuple(spans), kept.decode()))
    return Counter(out)


def stretches(at):
    while at:
        n = next((j for j in range(1, len(at)) if at[j] != at[0] + j), len(at))
        yield at[0], at[0] + n
        at = at[n:]


def passages(seed):
    """Texts that share passages of various lengths, copies, one word over and over, odd spaces, words that hash alike."""
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(300)     # noqa: E731
    common = [[word() for _ in range(n)] for n in (20, 34, 35, 36, 90, 400)]
    rows = [(None, None, None, None), (1, "", "en", "a"), (2, " \n\x0b", "en", "a"), (3, "a " * 200, "en", "a"), (4, "a\t" * 34, "en", "a"),
            (5, "é" * 70000 + " " + " ".join(common[4]), "en", "a"), (None, " ".join(common[3]), "en", "a")]
    for i in range(10, 60):
        parts = []
        for _ in range(rng.randrange(4)):
            parts += [word() for _ in range(rng.randrange(60))] + rng.choice(common)[rng.randrange(3):]
        rows.append((i, rng.choice([" ", "  ", "\n"]).join(parts), "en", "a"))
    thue = b"a"
    while len(thue) < 2048:
        thue += thue.translate(bytes.maketrans(b"ab", b"ba"))
    flip = thue.translate(bytes.maketrans(b"ab", b"ba"))
    tail = [word() for _ in range(40)]
    rows += [(70, " ".join([*tail[:20], thue.decode(), *tail[20:34]]), "en", "a"), (71, " ".join([*tail[:20], flip.decode(), *tail[20:34]]), "en", "a")]
    rows += [(80, rows[20][1], "en", "a"), (80, rows[20][1], "en", "a"), (81, " ".join(common[5][::-1]), "en", "a"), (82, "x " + " ".join(common[5][::-1]), "en", "a")]
    return rows


@pytest.mark.parametrize("k,m,part", [(35, 5, 4 << 20), (35, 5, 500), (3, 2, 4 << 20), (4, 4, 300), (1, 1, 200)])
def test_drop_repeats(spark, monkeypatch, k, m, part):
    monkeypatch.setattr(substrings, "PART", part)
    monkeypatch.setattr(substrings, "TOGETHER", 2000)
    rows = passages(k)
    got = substrings.drop_repeats(frame(spark, rows), k, m).collect()
    assert Counter((r.id, r.n_words, r.n_removed, tuple(tuple(s) for s in r.spans), r.kept) for r in got) == plain(rows, k)


def test_crowd_of_contexts(spark, monkeypatch):
    """One passage in hundreds of contexts is a large bucket; dealt in parts it gives the same."""
    rng = random.Random(9)
    common = ["c%d" % i for i in range(50)]
    rows = [(i, " ".join(["w%d" % rng.randrange(10 ** 6) for _ in range(40)] + common + ["w%d" % rng.randrange(10 ** 6) for _ in range(40)]), "en", "a")
            for i in range(400)]
    monkeypatch.setattr(substrings, "PART", 20000)
    seen, plainly = [], substrings.dealt_parts
    monkeypatch.setattr(substrings, "dealt_parts", lambda rows, k: seen.append(rows.count()) or plainly(rows, k))
    got = substrings.drop_repeats(frame(spark, rows)).collect()
    assert seen[0] > 400 and {(r.n_words, r.n_removed) for r in got} == {(130, 50)}


def test_empty_and_sql(spark):
    assert substrings.drop_repeats(frame(spark, [(1, "x", "en", "a")]).limit(0)).count() == 0
    sf = "/root/testdata/sf0.001"
    assert " MATCH " in compare(spark, duck(sf), sf, "op12_substrings", ent.queries()["op12_substrings"], ent.oracle_sql()["op12_substrings"])
    empty = hashlib.sha256(b"").hexdigest()
    assert all(len(r.kept_sha256) == 64 and (r.kept_sha256 == empty) == (r.n_words == r.n_removed)
               for r in ent.queries()["op12_substrings"](spark, sf).collect())


def test_ranks_gather_words_in_parts():
    """Addresses of bytes take eight times the bytes: only some words' are there at a time."""
    import tracemalloc

    import numpy as np

    from tessera.llm import substrings
    n, size = 200_000, 30
    buf = np.random.default_rng(0).integers(97, 100, n * size).astype(np.uint8)
    buf[:size] = buf[-size:]
    starts = np.arange(n) * size
    tracemalloc.start()
    ranks = substrings.word_ranks(buf, starts, starts + size)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(ranks) == n and ranks[0] == ranks[-1] and len(np.unique(ranks)) == n - 1
    assert peak < 8 * len(buf)
