"""The prefix trie against dictionaries of all prefixes, and against DuckDB."""

import collections
import hashlib
import random
import zlib

import duckdb
import pytest

from tidewire.llm import trie


def brute(paths):
    """Rows of the nodes of {conv_id: turns}, by listing every prefix of every conversation."""
    members = collections.defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = []
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = sorted(c for c in cs if len(paths[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        rows.append((min(cs), len(p), parent, len(cs), children[p], sum(not children[q] for q in below), saved, sha(",".join(map(str, ends)))))
    return sorted(rows, key=lambda r: (r[1], r[0]))


def turns_of(rows):
    found = collections.defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            found[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(ts)] for c, ts in found.items()}


def rebuilt(paths):
    out = {}
    for c, own in paths.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = paths.get(c - c % 5, [])[:h] + own[h:]
    return out


def made(seed, convs=60):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(3 * convs), convs):
        for t in range(r.choice([1, 2, 3, 5, 8, 12])):
            rows.append((c, t, r.choice(["user", "assistant"]) if t else "system", r.choice(["", "hé", "x", None]), "extra", 7))
    rows += [(900, t, "user", f"turn {t}", None, None) for t in range(70)]
    rows += [(905, None, None, None, None, None), (905, 1, "a", "b", None, None), (905, 1, "a", "b", None, None), (None, 1, "a", "b", None, None)]
    rows += [(c, t, "same", "long text " * 30, None, None) for c in range(1000, 1040) for t in range(4)]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, node string, depth int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def result(frame):
    assert sorted(frame.columns) == sorted(COLUMNS)
    return sorted((tuple(r) for r in frame.select(*COLUMNS).collect()), key=lambda r: (r[1], r[0]))


def test_conversations_as_they_are(spark):
    rows = made(1)
    assert result(trie.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == brute(turns_of(rows))


@pytest.mark.parametrize("source", ["made", "given"])
def test_query(spark, tmp_path, source):
    folder = "/root/testdata/sf0.001"
    if source == "made":
        spark.createDataFrame(made(2), SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
        folder = str(tmp_path)
    rows = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    want = brute(rebuilt(turns_of(rows)))
    assert result(trie.op12_prefix_trie(spark, folder)) == want
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{folder}/conversations.parquet{'/*.parquet' if source == 'made' else ''}'")
    assert sorted(con.execute(trie.OP12_SQL).fetchall(), key=lambda r: (r[1], r[0])) == want


def test_few_or_no_conversations(spark):
    frame = spark.createDataFrame([(7, 0, "a", "b", None, None), (7, 1, "a", "c", None, None)], SCHEMA)
    assert result(trie.conversation_trie(frame)) == brute({7: [("a", "b"), ("a", "c")]})
    assert result(trie.conversation_trie(frame.where("false"))) == []


def test_long_lists_of_ends_stream_in_chunks(spark):
    ids = random.Random(3).sample(range(10**6), 5000)
    ends = spark.createDataFrame([(1, 2, i) for i in ids] + [(1, 3, 4)], "node long, depth long, conv_id long")
    got = {(r.node, r.depth): r.ends_sha256 for r in trie.joined_digests(ends, chunk_bytes=100).collect()}
    assert got == {(1, 2): hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest(), (1, 3): hashlib.sha256(b"4").hexdigest()}
