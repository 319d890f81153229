"""Scoring, key and cleaning rules of the newsroom, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.text import once

# Other names of verdicts, and what a verdict teaches.
VERDICT_ALIASES = {"good": "approved", "useful": "approved", "полезно": "approved", "ok": "approved", "bad": "reject", "noise": "reject", "шум": "reject", "дубль": "merge_duplicate", "duplicate": "merge_duplicate", "merge": "merge_duplicate"}
VERDICT_SCORES = {"strong_signal": 100, "approved": 90, "merge_duplicate": 85, "watch_later": 40, "background_material": 25, "reject": -80, "wrong_domain": -80, "too_generic": -80, "bad_translation": 45, "needs_better_source": 45}
# What a recommended action adds to a candidate's learning score.
ACTION_BONUS = {"add": 25, "test_more": 12, "human_review": 6, "reject": -20}
# Upper-case words that name no company.
NO_COMPANIES = ["AI", "HSE", "PTW", "LOTO", "SIMOPS", "RSS"]


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def squeezed(c: Column) -> Column:
    """Runs of white space as one space, trimmed; null is empty."""
    return F.trim(F.regexp_replace(_text(c), r"\s+", " "))


def _among(values: dict, c: Column, default) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), c), F.lit(default))


def decimal_round(c: Column, digits: int) -> Column:
    return F.round(c.cast("decimal(38,10)"), digits).cast("double")


def clamp(c: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.when(c.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), c)))


def is_future(ts: Column, as_of: Column, tolerance_days: int = 2) -> Column:
    """Whether a time lies more than the tolerance after ``as_of``; null counts as no."""
    return F.coalesce(ts > as_of + F.make_interval(days=F.lit(tolerance_days)), F.lit(False))


def find_date(text: Column) -> Column:
    """The date (and time, in ISO form) that a text is or holds: 2024-05-06, 2024/5/6, 6.5.2024, "6 May 2024", "May 6, 2024"."""
    iso = F.regexp_extract(text, "^\\s*([0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2})?)", 1)
    timed = F.try_to_timestamp(F.rpad(F.replace(iso, F.lit("T"), F.lit(" ")), 19, ":00"), F.lit("yyyy-MM-dd HH:mm:ss"))
    held = lambda pattern: F.regexp_replace(F.regexp_extract(text, pattern, 1), "[/.]", "-")
    word = F.regexp_replace(F.regexp_extract(text, r"\b([0-9]{1,2}\s+[A-Za-z]{3,9}\.?\s+[0-9]{4}|[A-Za-z]{3,9}\.?\s+[0-9]{1,2},?\s+[0-9]{4})\b", 1), r"[.,]|\s+", " ")
    named = F.initcap(F.trim(F.regexp_replace(word, " +", " ")))
    short = F.regexp_replace(named, "([A-Za-z]{3})[a-z]*", "$1")
    parsed = [(held(r"\b([0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2})\b"), "yyyy-M-d"), (held(r"\b([0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})\b"), "d-M-yyyy"), (short, "d MMM yyyy"), (short, "MMM d yyyy")]
    return F.coalesce(F.when(iso != "", timed), *[F.when(v != "", F.try_to_timestamp(v, F.lit(f))) for v, f in parsed])


def first_date(*values: Column, as_of: Column) -> Column:
    """The first of several date texts that parses and is not in the future."""
    return F.coalesce(*[F.when(~is_future(p, as_of), p) for p in map(find_date, values)])


def search_text(*fields: Column) -> Column:
    """Lower-case fields with a space between; null is empty."""
    return F.lower(F.array_join(F.array(*[_text(f) for f in fields]), " "))


def contains_keyword(text: Column, keyword: str) -> Column:
    """Keywords of up to four characters, or of several words, anywhere; longer ones as whole words."""
    word = (keyword or "").strip().lower()
    if not word:
        return F.lit(False)
    if len(word) <= 4 or any(c.isspace() for c in word):
        return text.contains(word)
    return text.contains(word) & text.rlike(r"(?<![\p{L}\p{N}_])\Q" + word + r"\E(?![\p{L}\p{N}_])")


def stop_word_reason(text: Column, tags: list[tuple[str, list[str]]]) -> Column:
    """The first stop word of the tags in order, as a reason; null where none occurs."""
    return once(text, lambda t: F.coalesce(*[F.when(contains_keyword(t, w), f"стоп-слово «{w}» (тег «{name}»)") for name, words in tags for w in words]))


def keyword_tag(text: Column, tags: list[tuple[int, list[str]]], fallback: int) -> Column:
    """(tag_id, confidence, matches): the first tag with the most keywords, else the fallback."""
    count = lambda t, words: sum((contains_keyword(t, w).cast("int") for w in words), F.lit(0))
    best = once(text, lambda t: F.array_max(F.array(*[F.struct(count(t, words).alias("matches"), F.lit(-i).alias("turn"), F.lit(tag).alias("tag_id")) for i, (tag, words) in enumerate(tags)])))
    return once(best, lambda b: _tag_of(b, fallback))


def _tag_of(best: Column, fallback: int) -> Column:
    none = best["matches"] == 0
    confidence = F.when(none, F.lit(0.15)).otherwise(decimal_round(F.least(F.lit(0.9), best["matches"] * 0.08 + 0.35), 2))
    return F.struct(F.when(none, F.lit(fallback)).otherwise(best["tag_id"]).alias("tag_id"), confidence.alias("confidence"), best["matches"].alias("matches"))


def final_score(keyword: Column, ai: Column, keyword_weight: float = 0.2, ai_weight: float = 0.8) -> Column:
    """The greater of the model's score and its blend with the keyword score; without a model's score the keyword score."""
    given = F.coalesce(clamp(ai), keyword)
    return decimal_round(F.greatest(given, keyword * keyword_weight + given * ai_weight), 2)


def normalized_score(value: Column) -> Column:
    """A share as per cent, kept between 0 and 100; what is no number is 0."""
    x = F.coalesce(value.try_cast("double"), F.lit(0.0))
    x = F.when(F.isnan(x), 0.0).otherwise(x)
    return decimal_round(clamp(F.when((x > 0) & (x <= 1), x * 100).otherwise(x)), 2)


def normalized_verdict(value: Column) -> Column:
    low = F.lower(F.trim(_text(value)))
    named = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in VERDICT_ALIASES.items() for x in pair]), low), low)
    return F.when(named.isin(list(VERDICT_SCORES)), named)


def verdict_score(verdict: Column) -> Column:
    return _among(VERDICT_SCORES, verdict, 0)


def learning_score(tested: Column, relevant: Column, avg_score: Column, noise: Column, duplicates: Column, action: Column) -> Column:
    bonus = _among(ACTION_BONUS, _text(action), 0)
    parts = [F.coalesce(c, F.lit(0)) * w for c, w in ((relevant, 18), (tested, 2), (avg_score, 0.45), (noise, -10), (duplicates, -6))]
    return decimal_round(clamp((sum(parts[1:], parts[0]) + bonus).cast("double")), 2)


def quality_label(quality: Column, tested: Column, relevant: Column) -> Column:
    return (
        F.when(tested == 0, "сомнительный").when((quality >= 65) & (relevant >= 3), "сильный").when((quality >= 40) & (relevant > 0), "перспективный")
        .when(quality <= 20, "шумный").otherwise("сомнительный")
    )


def quality_risks(tested: Column, relevant: Column, noise: Column) -> Column:
    return F.array_compact(F.array(F.when(tested < 5, "few"), F.when(relevant == 0, "irrelevant"), F.when(noise > relevant, "noisy")))


def action_policy(action_type: Column) -> Column:
    """What may be done without a person: only searching for candidates."""
    human = ["review_source_candidate", "recheck_source", "audit_existing_source", "tune_source_frequency"]
    return F.when(action_type == "discover_sources", "auto").when(action_type.isin(human), "human_review").otherwise("blocked")


def address_key(url: Column) -> Column:
    """An address in lower case without scheme, fragment, query, closing slashes and www."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(_text(url))), "^https?://", ""), "[#?].*$", ""), "/+$", ""), r"^www\.", "")


def memory_key(kind: str, subject: Column, extra: Column) -> Column:
    """A key of agent memory; domains are their own key."""
    low = F.lower(F.trim(_text(subject)))
    if kind == "domain":
        return F.concat(F.lit("domain:"), low)
    return F.concat(F.lit(f"{kind}:"), F.substring(F.sha1(F.concat(F.lit(f"{kind}:"), F.lower(F.trim(_text(extra))), F.lit(":"), low)), 1, 16))


def memory_subject(value: Column, max_chars: int = 420) -> Column:
    text = squeezed(value)
    return F.when(F.length(text) <= max_chars, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, max_chars - 1)), F.lit("…")))


def feedback_key(kind: str, topic: Column, subject: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.substring(F.sha1(F.lower(F.concat(F.lit(f"{kind}:"), _text(topic), F.lit(":"), subject))), 1, 20))


def term_stems(text: Column, generic: list[str]) -> Column:
    """Distinct beginnings of six characters of words of five or more, without generic ones and numbers."""
    words = F.regexp_extract_all(F.translate(F.lower(_text(text)), "ё", "е"), F.lit("[a-zа-я0-9]{5,}"), F.lit(0))
    return F.array_distinct(F.filter(F.transform(words, lambda w: F.substring(w, 1, 6)), lambda s: ~s.isin(generic or [""]) & ~s.rlike("^[0-9]+$")))


def companies(text: Column, most: int = 8) -> Column:
    """The first distinct phrases of one to three capitalised words."""
    word = "[A-Z][A-Za-z0-9&.-]{2,}"
    found = F.regexp_extract_all(_text(text), F.lit(rf"\b{word}(?:\s+{word}){{0,2}}\b"), F.lit(0))
    return F.slice(F.array_distinct(F.filter(found, lambda c: ~F.upper(c).isin(NO_COMPANIES))), 1, most)


def normalized_theme(theme: Column, topic: Column) -> Column:
    """The theme, or the topic where the theme is in another script than the topic."""
    t, p = squeezed(theme), squeezed(topic)
    count = lambda c, letters: F.length(F.regexp_replace(F.lower(c), f"[^{letters}]", ""))
    foreign = t.rlike(r"[\x{3400}-\x{9FFF}]") | ((count(p, "а-яё") > 0) & (count(t, "a-z") > F.greatest(F.lit(8), count(t, "а-яё") * 2)))
    pick = lambda a, b: F.when(a != "", a).otherwise(b)
    return F.when(foreign, pick(p, t)).otherwise(pick(t, p))


def token_cost(input_tokens: Column, output_tokens: Column, rate_in: float, rate_out: float) -> Column:
    return (input_tokens * rate_in + output_tokens * rate_out) / 1e6


def hours_since_midnight(ts: Column, zone: str = "Europe/Moscow") -> Column:
    """Hours since the local midnight, at least 0.01."""
    local = F.from_utc_timestamp(ts, zone)
    seconds = F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)
    return decimal_round(F.greatest(seconds / 3600.0, F.lit(0.01)), 4)


def listing_hash(urls: Column, most: int = 10) -> Column:
    """SHA-256 of the first addresses of a listing, a line each; null for an empty listing."""
    return F.when(F.size(urls) > 0, F.sha2(F.array_join(F.slice(urls, 1, most), "\n"), 256))


def post_title(text: Column) -> Column:
    """The first sentence of a post, or the whole where that is short, cut at 140 characters."""
    whole = squeezed(text)
    first = F.get(F.split(whole, r"(?<=[.!?])\s+", 2), F.lit(0))
    return F.when(whole == "", "Telegram post").otherwise(F.trim(F.substring(F.when(F.length(first) < 25, whole).otherwise(first), 1, 140)))


def channel_name(address: Column) -> Column:
    """A channel's name from @name, a bare name or a t.me address; null for others."""
    raw = F.regexp_replace(F.trim(_text(address)), "^@", "")
    path = F.regexp_extract(raw, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?(?i:www\.)?(?i:t\.me|telegram\.me)/+([^?#]*)", 1)
    chunks = F.filter(F.split(path, "/"), lambda c: c != "")
    named = F.when((F.get(chunks, F.lit(0)) == "s") & (F.size(chunks) > 1), F.get(chunks, F.lit(1))).otherwise(F.get(chunks, F.lit(0)))
    valid = "^[A-Za-z0-9_]{3,64}$"
    return F.when(raw.rlike(valid), raw).when(named.rlike(valid), named)


def seed_address(raw: Column) -> Column:
    """A trimmed address with a scheme; null for blank."""
    t = F.trim(raw)
    return F.when(t == "", None).when(t.contains("://"), t).otherwise(F.concat(F.lit("https://"), t))


def distinct_paragraphs(text: Column) -> Column:
    """Paragraphs in order, each once."""
    return F.array_distinct(F.filter(F.transform(F.split(_text(text), "\n", -1), squeezed), lambda p: p != ""))


def split_values(text: Column) -> Column:
    """Values between semicolons or line ends, each once whatever its case, in order."""
    values = F.filter(F.transform(F.split(_text(text), "[;\n]", -1), squeezed), lambda v: v != "")
    firsts = lambda v, i: ~F.exists(F.slice(values, F.lit(1), i), lambda w: F.lower(w) == F.lower(v))
    return F.filter(values, firsts)


def summary_stub(title: Column, text: Column, sentences: int = 2) -> Column:
    """Title and first sentences, as a rule stands in for a model's summary."""
    return F.concat(squeezed(title), F.lit(": "), F.array_join(F.slice(F.split(squeezed(text), r"(?<=[.!?])\s+", -1), 1, sentences), " "))


def signal_key(title: Column, urls: Column, fingerprint: Column) -> Column:
    """Twenty-four digits of the only address of a signal's evidence, or else of its fact."""
    keys = F.array_distinct(F.transform(F.filter(urls, lambda u: u.isNotNull() & (u != "")), address_key))
    seed = F.when(F.size(keys) == 1, F.concat(F.lit("url:"), F.get(keys, F.lit(0)))).otherwise(F.concat(F.lit("fact:"), fingerprint))
    return F.substring(F.sha2(seed, 256), 1, 24)


def extraction_status(extracted: Column, current: Column, owned: Column, *, least: int, gain: float = 2.0) -> Column:
    """What becomes of an extracted text by its length and the present one's, and whether it belongs to the title."""
    better = (current < least) | (extracted >= current * gain)
    return F.when(extracted < least, "too_short").when(~better, "no_gain").when(owned, "ok").otherwise("mismatch")


def source_route(strategy: Column, region: Column, profile: Column, *, external: bool = True) -> Column:
    """(queue_name, region, capability) of a source's tasks."""
    browser = (F.lower(F.trim(_text(strategy))) == "playwright") | (F.lower(F.trim(_text(profile))) == "browser")
    outer = (F.lower(F.trim(_text(region))) == "external") & F.lit(external)
    queue = F.when(outer & browser, "external-playwright").when(outer, "external-fetch").when(browser, "playwright").otherwise("default")
    return F.struct(queue.alias("queue_name"), F.when(outer, "external").otherwise("ru").alias("region"), F.when(browser, "playwright").otherwise("http_fetch").alias("capability"))


def category_language(category: Column) -> Column:
    low = F.lower(_text(category))
    return F.when(low.rlike("рф|снг|россий|telegram"), "ru").when(low.contains("международ"), "en")


def merged_keywords(old: Column, new: Column) -> Column:
    """The old keywords, and those of the new that they and earlier new ones lack, whatever the case."""
    seen = F.transform(old, F.lower)
    fresh = F.filter(new, lambda k, i: ~F.array_contains(seen, F.lower(k)) & ~F.exists(F.slice(new, F.lit(1), i), lambda w: F.lower(w) == F.lower(k)))
    return F.concat(old, fresh)
