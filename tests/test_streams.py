"""Keyed state against plain replays."""

import datetime
import random

import pandas as pd
import pytest

from tidewire.plans import streams
from tidewire.streaming import state

START = datetime.datetime(2024, 1, 1)
SCHEMA = f"source_id long, fetched_at timestamp, posts array<{state.POST}>"


def replay(fetches):
    """Added posts of each fetch by going through them in order of time."""
    out, seen = [], {}
    for source, at, posts in sorted((f for f in fetches if f[0] is not None), key=lambda f: f[1]):
        hash_, url, last, known = seen.get(source, (None, None, None, set()))
        added, skipped, old = [], 0, 0
        key = [p[0] for p in posts[:20]]
        if posts and key == hash_:
            skipped = len(posts)
        elif posts:
            for p in posts:
                if url and p[0] == url:
                    skipped += 1
                    break
                if p[0] in known:
                    skipped += 1
                elif p[3] and last and p[3] <= last:
                    old += 1
                else:
                    added.append(p[0])
                    known.add(p[0])
            hash_, url, last = key, posts[0][0], posts[0][3]
        seen[source] = (hash_, url, last, known)
        out.append((source, at, tuple(added), skipped, old))
    return sorted(out)


def made(seed):
    r = random.Random(seed)
    fetches = []
    for source in range(6):
        posts = [(f"u{source}/{i}", f"t{i}", "x", START + datetime.timedelta(hours=i) if r.random() < 0.9 else None) for i in range(40)]
        for k in range(9):
            last = r.randrange(1, 40)
            shown = posts[max(0, last - r.randrange(1, 25)) : last][::-1]
            fetches.append((source, START + datetime.timedelta(days=k, minutes=r.randrange(60)), r.choice([shown, shown, shown, [], shown[::2]])))
    return [*fetches, (None, START, [("u", "t", "x", START)])]


def test_channels_in_several_runs(spark):
    fetches = made(4)
    slices = [[f for f in fetches if k * 3 <= (f[1] - START).days < k * 3 + 3] for k in range(3)]
    got = streams.in_runs([spark.createDataFrame(s, SCHEMA) for s in slices], state.channel_ingest, "t")
    rows = sorted((r.source_id, r.fetched_at, tuple(p.url for p in r.added), r.skipped_known, r.skipped_old) for r in got.collect())
    assert rows == replay(fetches) and any(r[4] for r in rows)


def test_addresses_that_are_forgotten_are_held_back_by_date(spark):
    post = lambda i: (f"u{i}", "t", "x", START + datetime.timedelta(hours=i))
    fetches = [(1, START, [post(2), post(1)]), (1, START + datetime.timedelta(days=40), [post(3)]), (1, START + datetime.timedelta(days=41), [post(4), post(1), post(2)])]
    got = streams.in_runs([spark.createDataFrame([f], SCHEMA) for f in fetches], lambda s: state.channel_ingest(s, known_for_days=30), "t")
    assert sorted(tuple(p.url for p in r.added) for r in got.collect()) == [("u2", "u1"), ("u3",), ("u4",)] and max(r.skipped_old for r in got.collect()) == 2


def test_leases_run_out_and_belong_to_their_holder(spark):
    steps = [
        (1, 1, 0, "claim", "a"), (1, 2, 5, "beat", "b"), (1, 3, 50, "beat", "a"), (1, 4, 109, "beat", "a"), (1, 5, 300, "finish", "a"), (1, 6, 301, "claim", "c"), (1, 7, 302, "finish", "c"),
        (2, 8, 0, "claim", "a"), (2, 9, 100, "claim", "b"), (2, 10, 150, "fail", "b"), (2, 11, 160, "claim", "c"), (3, 12, 300, "claim", "a"), (4, 13, 0, "beat", "x"), (5, 14, 250, "claim", "a"),
    ]
    rows = [(job, event, START + datetime.timedelta(seconds=at), kind, token) for job, event, at, kind, token in steps]
    schema = "job_id long, event_id long, at timestamp, kind string, token string"
    frames = [spark.createDataFrame([r for r in rows if low <= (r[2] - START).seconds < high], schema) for low, high in ((0, 60), (60, 200), (200, 400))]
    got = streams.in_runs(frames, lambda s: state.lease_lifetimes(s, lease_seconds=60, most=2), "t").collect()
    last = {r.job_id: r for r in sorted(got, key=lambda r: r.seq)}
    assert {j: (r.status, r.attempts, r.renewed, r.refused) for j, r in last.items()} == {
        1: ("ok", 2, 2, 2), 2: ("failed", 2, 0, 0), 3: ("running", 1, 0, 0), 4: ("queued", 0, 0, 1), 5: ("running", 1, 0, 0),
    }


class Kept:
    """A value, timers or a map of state that counts what is asked of it."""

    def __init__(self, value=None):
        self.value, self.asked = value, []

    def __getattr__(self, name):
        def ask(*given):
            self.asked.append(name)
            if name == "update":
                self.value = given[0]
            return {"get": self.value, "containsKey": False}.get(name)

        return ask


def test_a_job_asks_its_state_only_what_it_needs():
    lease, moments = state._Lease(60_000, 3), pd.to_datetime([START + datetime.timedelta(seconds=s) for s in (9, 1, 5)])
    lease.handle, lease.job = Kept(), Kept()
    rows = pd.DataFrame({"at": moments, "event_id": [3, 1, 2], "kind": ["beat", "claim", "beat"], "token": ["b", "a", "a"]})
    row = next(lease.handleInputRows((1,), iter([rows[:2], rows[2:]]), None))
    assert row[["status", "attempts", "renewed", "refused"]].values.tolist() == [["running", 1, 1, 1]]
    assert (lease.job.asked, lease.handle.asked) == (["get", "update"], ["registerTimer"])
    late = pd.DataFrame({"at": moments[:1], "event_id": [4], "kind": ["claim"], "token": ["c"]})
    next(lease.handleInputRows((1,), iter([late]), None))
    assert lease.handle.asked == ["registerTimer"]  # its lease ends when it did


@pytest.mark.parametrize("before,looked_up", [(None, 0), (("h", "u0", None), 2)])
def test_a_channel_seen_first_looks_up_nothing(before, looked_up):
    channel = state._Channel(0)
    channel.last, channel.known = Kept(before), Kept()
    posts = [{"url": f"u{i}", "title": "t", "text": "x", "published_at": None} for i in (2, 1)]
    fetches = pd.DataFrame({"fetched_at": pd.to_datetime([START, START + datetime.timedelta(hours=1)]), "posts": [posts, posts], "listing_hash": ["g", "g"]})
    out = next(channel.handleInputRows((1,), iter([fetches]), None))
    assert [len(a) for a in out["added"]] == [2, 0] and out["skipped_known"].tolist() == [0, 2]
    assert channel.known.asked == ["containsKey"] * looked_up + ["updateValue"] * 2 and channel.last.asked == ["get", "update"]
