"""Substring operators against counting every window."""

import collections
import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest

from tidewire.llm import substring_dedup, suffix_dedup


def brute(texts, length, split, join):
    """(elements, removed, runs, digest) of each text, by a table of all windows."""
    sequences = [split((t or "").encode()) for t in texts]
    counts = collections.Counter(join(s[i : i + length]) for s in sequences for i in range(len(s) - length + 1))
    out = []
    for s in sequences:
        cover = np.zeros(len(s), bool)
        for i in range(len(s) - length + 1):
            if counts[join(s[i : i + length])] > 1:
                cover[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        kept = join([x for x, c in zip(s, cover) if not c])
        out.append((len(s), int(cover.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


OPERATORS = {
    "bytes": (suffix_dedup.repeat_job, 12, list, bytes),
    "words": (substring_dedup.repeat_job, 5, lambda b: re.findall(rb"[^\x20\x09-\x0d]+", b), b" ".join),
}


def made_texts():
    r = random.Random(3)
    base = "".join(r.choice("abé \n") for _ in range(300))
    texts = [None, "", "a" * 500, "ab" * 200, base, base[50:150] + base[:100], base, "x" + base[10:80] + "y", "short"]
    texts += ["".join(r.choice("ab ") for _ in range(r.randrange(200))) for _ in range(60)]
    return texts + [" ".join(r.choice(["one", "two", "three"]) for _ in range(2500)) * 2]


@pytest.mark.parametrize("name", OPERATORS)
@pytest.mark.parametrize("hot", [50_000, 2])
def test_matches_brute_force(spark, name, hot):
    job, length, split, join = OPERATORS[name]
    texts = made_texts()
    frame = spark.createDataFrame(pd.DataFrame({"doc_id": range(len(texts)), "text": texts}), "doc_id long, text string")
    found = sorted(job(frame, length=length, hot_runs=hot).removed(True).collect())
    assert [(r.n_elements, r.n_removed, len(r.removed_runs), r.kept) for r in found] == brute(texts, length, split, join)


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_and_empty(spark, odd, empty, name):
    job, length, split, join = OPERATORS[name]
    rows = odd.select("doc_id", "text").collect()
    want = collections.Counter((r.doc_id, *x) for r, x in zip(rows, brute([r.text for r in rows], length, split, join)))
    found = job(odd, length=length).removed(True).collect()
    assert collections.Counter((r.doc_id, r.n_elements, r.n_removed, len(r.removed_runs), r.kept) for r in found) == want
    assert job(empty, length=length).removed(True).count() == 0


def test_kept_text(spark):
    shared = "this passage stands in both of the texts word for word"
    frame = spark.createDataFrame([(1, f"Start,  one. {shared}  End one."), (2, f"{shared} two")], "doc_id long, text string")
    kept = {r.doc_id: r.kept for r in substring_dedup.repeat_job(frame, length=8).removed(False).collect()}
    assert kept == {1: "Start,  one.   End one.", 2: " two"}


def test_groups_have_all_occurrences(spark):
    word = "the repeated string of some length"
    frame = spark.createDataFrame([(i, f"{i}{chr(97 + i)}|{word}|{chr(110 + i)}{i}") for i in range(5)], "doc_id long, text string")
    groups = suffix_dedup.repeat_groups(frame, length=20).collect()
    covered = {r.doc_id: set() for r in groups}
    for r in groups:
        covered[r.doc_id] |= set(range(r.begin, r.begin + r.size))
    assert {d: len(c) for d, c in covered.items()} == {i: len(word) + 2 for i in range(5)}
    by_group = collections.Counter(r.group for r in groups)
    assert set(by_group.values()) == {5}


def test_groups_list_copies(spark):
    passage, alone = "a passage that copies and a partial sharer have", "copied as a whole and shared with no other text"
    texts = [f"12 {passage} 34"] * 3 + [f"<{passage}>", alone, alone, "too short", "too short", None, None]
    groups = suffix_dedup.repeat_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), length=20).collect()
    covered, by_group = collections.defaultdict(set), collections.defaultdict(set)
    for r in groups:
        by_group[r.group].add((r.doc_id, r.begin, texts[r.doc_id].encode()[r.begin : r.begin + r.size]))
        covered[r.doc_id] |= set(range(r.begin, r.begin + r.size))
    assert all(len({text for *_, text in g}) == 1 for g in by_group.values())
    assert {d: len(c) for d, c in covered.items()} == {**dict.fromkeys(range(3), len(texts[0])), 3: len(passage), 4: len(alone), 5: len(alone)}
    shared = [g for g in by_group.values() if any(d == 3 for d, *_ in g)]
    assert shared and all({d for d, *_ in g} == {0, 1, 2, 3} for g in shared)
    assert {(4, 0, alone.encode()), (5, 0, alone.encode())} in by_group.values()


def test_suffix_array_is_sorted():
    r = random.Random(1)
    segments = [bytes(r.choice(b"ab") for _ in range(r.randrange(1, 60))) for _ in range(20)]
    data = np.frombuffer(b"".join(segments), np.uint8)
    edges = np.cumsum([0, *map(len, segments)])
    ends = np.repeat(edges[1:], np.diff(edges))
    order, lcp = suffix_dedup.enhanced_suffix_array(data, ends, np.arange(len(data)))
    suffixes = [data[p : ends[p]].tobytes() for p in order]
    assert suffixes == sorted(suffixes)
    for a, b, n in zip(suffixes, suffixes[1:], lcp[1:]):
        assert a[:n] == b[:n] and (len(a) == n or len(b) == n or a[n] != b[n])
