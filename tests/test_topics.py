"""Tag choice against comparing every topic with every tag."""

import random
import re

from tidewire.operators import tag_choice


def norm(text):
    return re.sub(r"\s+", " ", (text or "").lower().replace("ё", "е")).strip()


def share(a, b):
    words = lambda t: {w for w in re.findall("[a-zа-яё0-9]{4,}", t) if w not in ("and", "with", "news")}
    return bool(words(a) & words(b))


def chosen(topic, tags):
    t, by_id = norm(topic), {x["id"]: x for x in tags}
    exact = {x["id"] for x in tags if norm(x["name"]) == t}
    if exact:
        picked = {x["id"] for x in tags if x["id"] in exact or x["parent_id"] in exact}
    else:
        direct = set()
        for x in tags:
            above = by_id.get(x["parent_id"], {"name": None, "name_en": None})
            fields = [norm(f) for f in (x["name"], x["name_en"], x["description"], above["name"], above["name_en"])]
            keys = [norm(k) for k in x["keywords"] or []]
            if any(f and (f in t or t in f or share(t, f)) for f in fields) or any(k and (k in t or share(t, k)) for k in keys):
                direct.add(x["id"])
        parents = {by_id[d]["parent_id"] for d in direct}
        picked = {x["id"] for x in tags if x["id"] in direct or x["id"] in parents or x["parent_id"] in direct}
    return [x["id"] for x in sorted(tags, key=lambda x: (x["place"], x["id"])) if x["id"] in picked][:24]


def test_topic_tags(spark):
    r = random.Random(6)
    words = ["oil", "gas", "drilling", "Бурение", "ёмкость", "safety", "news", "AI", "well", "field", "work", "и", "x"]
    phrase = lambda: " ".join(r.choice(words) for _ in range(r.choice([1, 1, 2, 3])))
    tags = [{"id": i, "parent_id": r.choice([None, *range(1, 8)]) if i > 7 else None, "place": r.randrange(100), "name": phrase(), "name_en": r.choice([None, "", phrase()]), "description": r.choice([None, phrase()]), "keywords": r.choice([None, [], [phrase(), phrase()]])} for i in range(1, 70)]
    topics = [*{phrase() for _ in range(60)}, "", " ", None, "DRILLING  well", "l", "zzz"]
    frame = spark.createDataFrame([tuple(t.values()) for t in tags], "id long, parent_id long, place int, name string, name_en string, description string, keywords array<string>")
    rows = tag_choice.topic_tags(spark.createDataFrame([(t,) for t in topics], "topic string"), frame).collect()
    got = {}
    for row in sorted(rows, key=lambda x: x.place):
        got.setdefault(row.topic, []).append(row.tag_id)
    want = {t: chosen(t, tags) for t in topics if t and t.strip()}
    assert got == {t: w for t, w in want.items() if w}
