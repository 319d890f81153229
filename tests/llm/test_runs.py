"""Runs against trying every period at every position."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from tidewire.llm import runs


def brute_runs(x, least=24, times=3):
    """All maximal runs by comparing every distance; only smallest periods count."""
    n, found = len(x), []
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            if x[i] != x[i + p]:
                i += 1
                continue
            start = i
            while i + p < n and x[i] == x[i + p]:
                i += 1
            length = i + p - start
            word = x[start : start + p]
            smallest = all(p % d or word != word[:d] * (p // d) for d in range(1, p))
            if length >= max(least, times * p) and smallest:
                found.append((start, p, length))
    return sorted(found)


def rewritten(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [*words[:a], *(words[a + (i - a) % p] for i in range(a, n))]
    return words


def contract(doc_id, text):
    """The row of op11 by its wording."""
    words = rewritten(doc_id, text)
    found = brute_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + p <= i < s + n for s, p, n in found)]
    best = None
    for s, p, n in found:
        if best is None or n * best[1] > best[2] * p:
            best = (s, p, n)
    lines = "".join(f"{s},{n},{p}\n" for s, p, n in found)
    top = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
    return (doc_id, len(found), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(" ".join(kept).encode()).hexdigest())


def plain_next_smaller(x):
    n = len(x)
    after = [next((j for j in range(i + 1, n) if x[j:] < x[i:]), n) for i in range(n)]
    same = lambda i, j: next((k for k in range(n - j) if x[i + k] != x[j + k]), n - j)
    return after, [same(i, j) if j < n else 0 for i, j in enumerate(after)]


def test_next_smaller_suffixes():
    for n in range(1, 11):
        for x in itertools.product((0, 1), repeat=n):
            assert runs.next_smaller(list(x)) == plain_next_smaller(list(x))


class Counted(int):
    """A number that counts its comparisons."""

    seen = 0

    def __eq__(self, other):
        Counted.seen += 1
        return int(self) == int(other)

    __hash__ = int.__hash__


def grown(r, size):
    x = [r.randrange(2) for _ in range(3)]
    while len(x) < size:
        x = x + r.choice([x, [r.randrange(3)], x[: r.randrange(1, len(x) + 1)], x[r.randrange(len(x)) :]])
    return x


def test_words_are_compared_a_bounded_number_of_times():
    r = random.Random(5)
    made = [grown(r, 4000) for _ in range(60)] + [[0] * 4000, [0] * 2000 + [1] + [0] * 2000, [(i & -i).bit_length() for i in range(1, 4000)]]
    for x in made:
        Counted.seen = 0
        runs.next_smaller([Counted(c) for c in x])
        assert Counted.seen < 2 * len(x) + 10


@pytest.mark.parametrize("least,times", [(3, 3), (8, 4)])
def test_runs_of_sequences(least, times):
    r = random.Random(2)
    made = [list(x) for n in (9, 12) for x in itertools.product((0, 1), repeat=n)] + [grown(r, 200)[:200] for _ in range(40)]
    for x in made:
        assert runs.periodic_runs(x, least, times) == brute_runs(x, least, times)


def made_texts():
    r = random.Random(9)
    word = lambda: r.choice(["a", "b", "ä", "zwei", "three"])
    texts = [None, "", "  ", "x " * 23, "x " * 24, "x\x0b" * 500, "a b " * 12 + "a", "one line of eight words stands here thrice\n" * 3]
    texts += [" ".join(word() for _ in range(r.randrange(90))) for _ in range(40)]
    for _ in range(60):
        p = r.randrange(1, 40)
        root = [f"w{r.randrange(60)}" for _ in range(p)]
        texts.append(" ".join([word(), *(root * 9)[: r.randrange(9 * p)], word(), *root * 2, word()]))
    return texts + [" ".join(f"w{i % 700}" for i in range(9000))]


def test_query_by_its_wording(spark, tmp_path):
    texts = made_texts()
    rows = [(i, t, "en", 5, "x") for i, t in enumerate(texts)] + [(None, "u v w " * 20, None, 1, "y"), (3, "u v w " * 20, None, 1, "y")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, n_runs int, start string").write.parquet(str(tmp_path / "documents.parquet"))
    got = runs.op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(contract(r[0], r[1])) for r in rows)


def test_query_on_given_documents(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    rows = [r for r in rows if len((r.text or "").split()) < 800]
    got = {r.doc_id: tuple(r) for r in runs.op11_periodic_runs(spark, folder).collect()}
    assert all(got[r.doc_id] == contract(r.doc_id, r.text) for r in rows) and any(got[r.doc_id][1] for r in rows)


def test_texts_and_frames(spark, odd, empty):
    row = runs.find_runs(spark.createDataFrame([(1, "head " + "ä b c " * 9 + "tail")], "key long, body string"), id_column="key", text_column="body").first()
    assert (row.key, row.n_words, row.collapsed) == (1, 29, "head ä b c tail")
    assert [tuple(x) for x in row.runs] == [(1, 27, 3)]
    assert runs.find_runs(odd).count() == odd.count() and runs.find_runs(empty).count() == 0
    with pytest.raises(ValueError):
        runs.find_runs(odd, min_exponent=2)
