"""Near duplicates against all pairs."""

import collections
import random
import re

import pandas as pd
import pytest

from tidewire.llm import components, minhash


def brute(ids, texts, words, percent):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(lower))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                parent[root(a)] = root(b)
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)], least[root(i)] == d) for i, d in enumerate(ids))


def made_texts():
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", "  ", "One", "one", "one two"]
    for _ in range(5):
        base = [r.choice(words) for _ in range(r.choice([5, 12, 40, 80, 200]))]
        for _ in range(30):
            w = list(base)
            for _ in range(r.randrange(0, max(2, len(w) // 25) + 1)):
                w[r.randrange(len(w))] = r.choice(words)
            texts.append(" ".join(w))
    return texts + [" ".join(r.choice(words) for _ in range(30)) + " the license text is the same in all of these files and goes on" * 3 for _ in range(40)]


@pytest.mark.parametrize(("words", "percent", "block"), [(3, 85, 256), (3, 85, 8), (5, 80, 256)])
def test_matches_all_pairs(spark, words, percent, block):
    texts = made_texts()
    frame = spark.createDataFrame(pd.DataFrame({"doc_id": range(len(texts)), "text": texts}), "doc_id long, text string")
    found = minhash.NearDuplicates(frame, words=words, percent=percent, block=block).result().collect()
    assert sorted(map(tuple, found)) == brute(list(range(len(texts))), texts, words, percent)


def test_odd_and_empty(spark, odd, empty):
    rows = [tuple(r) for r in minhash.NearDuplicates(odd).result().collect()]
    assert len(rows) == odd.count()
    assert collections.Counter(r[:2] for r in rows)[(3, 1)] == 2  # repeated rows stay
    by = {r[0]: r for r in rows}
    assert by[5] == (5, 1, 3, False) and by[1] == (1, 0, 1, True) and by[None][2] == 3
    assert minhash.deduplicate(odd).columns == odd.columns
    assert minhash.NearDuplicates(empty).result().count() == 0


def test_components(spark):
    r = random.Random(2)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 330)]
    parent = {x: x for pair in links for x in pair}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    found = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {x: root(x) for a, b in links if a != b for x in (a, b)}
