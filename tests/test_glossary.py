"""Large glossaries against trying every term on every text."""

import random
import re

import pytest

from tidewire.operators import glossary


def contains(text, term):
    term = term.strip().lower()
    if not term:
        return False
    if len(term) <= 4:
        return re.search(rf"(?<![a-zа-я0-9]){re.escape(term)}(?![a-zа-я0-9])", text, re.I) is not None
    if re.search(r"\s", term):
        return term in text
    return re.search(rf"\b{re.escape(term)}\b", text, re.I) is not None


def made():
    r = random.Random(8)
    parts = ["oil", "gas", "ГРП", "co2", "h2s-", "drill", "бурение", "скважина", "well", "ü", "_x", "(eor)", "压裂", "lift"]
    spelling = lambda: r.choice(["", " "]).join(r.choice(parts) for _ in range(r.choice([1, 1, 2, 3])))
    terms = [glossary.Term(tuple(spelling() for _ in range(r.choice([1, 2]))), f"T{i}", (rf"\bdrill(?:ing)?{i % 3}\b",) if i % 4 == 0 else (), (spelling(),) if i % 3 == 0 else ()) for i in range(150)]
    texts = [None, "", " ", *(r.choice([" ", "", "-", ", "]).join(r.choice([*parts, "OIL", "Drill0", "the", "Ё"]) for _ in range(r.randrange(1, 12))) for _ in range(150))]
    return terms, texts


def test_relevant_and_enforced(spark):
    terms, texts = made()
    rows = [(i, t, texts[-i - 1]) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "id long, title string, body string")
    repairs, polish = [(r"\bthe\b", "THE-")], [("ё+", "е")]
    got = {r.id: r for r in glossary.enforced(glossary.relevant_terms(frame, ["title", "body"], terms), "title", ["title", "body"], terms, repairs=repairs, polish=polish).collect()}
    for i, title, body in rows:
        article = f"{title or ''} {body or ''}".lower()
        wanted = [n for n, t in enumerate(terms) if any(contains(article, s) for s in t.source)][:12]
        out = title or ""
        if wanted:
            out = re.sub(r"\bthe\b", "THE-", out, flags=re.I)
        for t in (terms[n] for n in wanted):
            for w in t.words:
                out = re.sub(rf"(?<![А-Яа-яA-Za-z0-9]){re.escape(w)}(?![А-Яа-яA-Za-z0-9])", t.preferred, out, flags=re.I)
            for p in t.forbidden:
                out = re.sub(p, t.preferred, out, flags=re.I)
        out = re.sub("ё+", "е", out, flags=re.I)
        if re.match("[а-яё]", out, re.I):
            out = out[0].upper() + out[1:]
        assert (got[i].terms, got[i].enforced) == (wanted, out)


def test_replacements_in_order(spark):
    r = random.Random(3)
    words = ["oil", "gas", "well", "oil well", "压裂", "压", "бур", "Gas-lift"]
    pairs = [(r.choice(words), r.choice([*words, r"\1x", "new"])) for _ in range(25)] + [("", "x"), ("x", " ")]
    texts = [None, *(r.choice([" ", "", "-"]).join(r.choice([*words, "OIL", "Бур"]) for _ in range(r.randrange(7))) for _ in range(120))]
    got = {x.id: x.replaced for x in glossary.replaced(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "t", pairs).collect()}
    for i, text in enumerate(texts):
        out = text or ""
        for source, preferred in pairs:
            if source.strip() and preferred.strip():
                out = out.replace(source, preferred) if re.search("[㐀-鿿]", source) else re.sub(rf"\b{re.escape(source)}\b", lambda _, p=preferred: p, out, flags=re.I)
        assert got[i] == out


def test_size_is_checked(spark, monkeypatch):
    monkeypatch.setattr(glossary, "MOST_CHARS", 10)
    with pytest.raises(ValueError):
        glossary.Spellings([("a" * 11, 0)])
