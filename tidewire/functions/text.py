"""Text functions of the newsroom, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "yclid", "ymclid", "_openstat", "igshid", "mc_cid", "mc_eid"]
# Endings of cut feed texts.
CUT_MARKERS = ["read more", "read the full", "read full", "continue reading", "see more", "view more", "full story", "[…]", "[...]", "читать далее", "читать полностью", "подробнее", "продолжение", "далее по ссылке"]
# Words that prove nothing about whom a text belongs to.
COMMON_WORDS = (
    "и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня еще нет о из ему теперь когда даже ну вдруг ли если или быть был для "
    "тем чтобы чем это эта эти этот при над под без до после через между также млн млрд тыс года году год гг рф сша the a an and or of to in for on at by with from is are was were be "
    "been has have had it that this these those as not but which who will would can could may might more most new its into"
).split()
# Symbols shown as pictures by default, and the characters that join them.
PICTURES = r"\x{231A}-\x{231B}\x{23E9}-\x{23EC}\x{23F0}\x{23F3}\x{25FD}-\x{25FE}\x{2614}-\x{2615}\x{2648}-\x{2653}\x{267F}\x{2693}\x{26A1}\x{26AA}-\x{26AB}\x{26BD}-\x{26BE}\x{26C4}-\x{26C5}\x{26CE}\x{26D4}\x{26EA}\x{26F2}-\x{26F3}\x{26F5}\x{26FA}\x{26FD}\x{2705}\x{270A}-\x{270B}\x{2728}\x{274C}\x{274E}\x{2753}-\x{2755}\x{2757}\x{2795}-\x{2797}\x{27B0}\x{27BF}\x{2B1B}-\x{2B1C}\x{2B50}\x{2B55}\x{1F004}\x{1F0CF}\x{1F18E}\x{1F191}-\x{1F19A}\x{1F1E6}-\x{1F1FF}\x{1F300}-\x{1F320}\x{1F32D}-\x{1F335}\x{1F337}-\x{1F37C}\x{1F37E}-\x{1F393}\x{1F3A0}-\x{1F3CA}\x{1F3CF}-\x{1F3D3}\x{1F3E0}-\x{1F3F0}\x{1F3F4}\x{1F3F8}-\x{1F43E}\x{1F440}\x{1F442}-\x{1F4FC}\x{1F4FF}-\x{1F53D}\x{1F54B}-\x{1F54E}\x{1F550}-\x{1F567}\x{1F57A}\x{1F595}-\x{1F596}\x{1F5A4}\x{1F5FB}-\x{1F64F}\x{1F680}-\x{1F6C5}\x{1F6CC}\x{1F6D0}-\x{1F6D2}\x{1F6EB}-\x{1F6EC}\x{1F6F4}-\x{1F6FC}\x{1F7E0}-\x{1F7EB}\x{1F90C}-\x{1F93A}\x{1F93C}-\x{1F945}\x{1F947}-\x{1F9FF}\x{1FA70}-\x{1FAF8}"
JOINERS = r"\x{1F3FB}-\x{1F3FF}\x{FE0F}\x{FE0E}\x{200D}\x{20E3}\x{E0020}-\x{E007F}"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def collapsed(c: Column) -> Column:
    """Runs of white space as one space, trimmed; null is empty."""
    return F.trim(F.regexp_replace(_text(c), r"[\s\x{A0}]+", " "))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row; repeated in branches and lambdas, a Column is computed each time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def url_key(url: Column) -> Column:
    """Host and path in lower case, without scheme, www., query, fragment and closing slashes; null for blank."""
    low = F.lower(F.trim(_text(url)))
    bare = F.regexp_replace(F.regexp_replace(low, r"^[a-z][a-z0-9+.\-]*://(www\.)?", ""), r"[?#].*$", "")
    return F.nullif(F.when(low.contains("://"), F.regexp_replace(bare, "/+$", "")).otherwise(low), F.lit(""))


def content_hash(title: Column, url: Column) -> Column:
    """SHA-256 of normalised title and address."""
    address = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(_text(url))), r"^[a-z][a-z0-9+.\-]*://", ""), r"[?#].*$", ""), "/+$", "")
    return F.sha2(F.concat(F.lower(collapsed(title)), F.lit("|"), address), 256)


def body_hash(text: Column) -> Column:
    """SHA-256 of the lower-case text with white space collapsed; null for blank texts."""
    return F.sha2(F.nullif(F.lower(collapsed(text)), F.lit("")), 256)


def is_truncated(text: Column, min_chars: int = 280) -> Column:
    """Empty, ends in an ellipsis, closes with a marker, or is short."""
    t = F.trim(_text(text))
    tail = F.lower(F.right(t, F.lit(60)))
    marked = F.lit(False)
    for marker in CUT_MARKERS:
        marked = marked | tail.contains(marker)
    ends = t.endswith("…") | t.endswith("...") | t.endswith("[…]") | t.endswith("[...]")
    return (t == "") | ends | marked | (F.length(t) < min_chars)


def significant_words(text: Column) -> Column:
    """Words of over three characters that are not common, cut to five."""
    words = F.regexp_extract_all(F.lower(_text(text)), F.lit("[а-яёa-z0-9]{4,}"), F.lit(0))
    return F.transform(F.filter(words, lambda w: ~w.isin(COMMON_WORDS)), lambda w: F.substring(w, 1, 5))


def title_matches_body(title: Column, body: Column, ratio: float = 0.2, least_words: int = 4) -> Column:
    """Whether the body shares enough words with the best segment of the title; true where that cannot be judged."""
    segments = F.transform(F.split(_text(title), r"\s+[—–|·]\s+|\s+-\s+"), lambda s: F.array_distinct(significant_words(s)))
    judged = F.filter(segments, lambda s: F.size(s) >= least_words)

    def matches(own: Column) -> Column:
        best = F.array_max(F.transform(judged, lambda s: F.size(F.array_intersect(s, own)) / F.size(s)))
        return (F.size(own) == 0) | F.coalesce(best >= ratio, F.lit(True))  # null: no segment is judged

    return once(F.array_distinct(significant_words(body)), matches)


def strip_emoji(text: Column) -> Column:
    """Without picture symbols and joiners; runs of blanks become one."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(_text(text), f"[{PICTURES}{JOINERS}]", ""), r"[ \t]{2,}", " "), r"^[ \t]+|[ \t]+$", "")


def needs_translation(title: Column) -> Column:
    """Under half of the letters are Cyrillic; false without letters."""
    letters = F.length(F.regexp_replace(_text(title), r"[^\p{L}]", ""))
    cyrillic = F.length(F.regexp_replace(_text(title), r"[^\p{IsCyrillic}]", ""))
    return (letters > 0) & (cyrillic < 0.5 * letters)


def guess_language(text: Column) -> Column:
    return F.when(F.lower(F.substring(_text(text), 1, 3000)).rlike("[а-я]"), "ru").otherwise("en")


def score_label(score: Column) -> Column:
    return F.when(score >= 80, "Высокая").when(score >= 65, "Выше средней").when(score >= 40, "Средняя").otherwise("Низкая")


def normalize_domain(url: Column) -> Column:
    """Host in lower case, without scheme, user, port and www."""
    host = F.regexp_replace(F.regexp_replace(F.lower(F.trim(_text(url))), r"^[a-z][a-z0-9+.\-]*://", ""), r"[/?#].*$", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r":\d+$", ""), r"^www\.", "")


def clean_query(query: Column) -> Column:
    """A query string without tracking parameters, in order."""
    parts = F.filter(F.split(_text(query), "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(TRACKING))
    return F.array_join(parts, "&")


def clean_html(text: Column) -> Column:
    """Tags as spaces, the basic entities, white space collapsed."""
    out = F.regexp_replace(_text(text), "<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return collapsed(out)


def keyword_hits(text: Column, keywords: list[str]) -> Column:
    """Keywords in a text: those of ASCII letters and digits as whole words, others anywhere; ё counts as е in the text."""
    inside = "a-z0-9а-я&/-"

    def found(plain: Column, k: str) -> Column:
        words = k.split(" ")
        if not (k.isascii() and k.replace(" ", "").isalnum()):
            return plain.contains(k)
        if "" in words:  # two blanks stand together only at the ends
            return F.concat(F.lit(" "), F.regexp_replace(plain, f"[^{inside}]+", " "), F.lit(" ")).contains(f" {k} ")
        return plain.contains(words[0]) & plain.rlike(f"(?<![{inside}])" + f"[^{inside}]+".join(words) + f"(?![{inside}])")

    return once(F.replace(F.lower(_text(text)), F.lit("ё"), F.lit("е")), lambda plain: F.array_compact(F.array(*[F.when(found(plain, k), F.lit(k)) for k in keywords])))


def should_keep(title: Column, summary: Column, positive: list[str], noise: list[str]) -> Column:
    """Dropped only with a noise keyword and no positive one."""
    text = F.concat(_text(title), F.lit(" "), _text(summary))
    return ~((F.size(keyword_hits(text, noise)) > 0) & (F.size(keyword_hits(text, positive)) == 0))


def keyword_score(text: Column, keywords: list[str]) -> Column:
    """Share of matched keywords, from 0 to 100."""
    if not keywords:
        return F.lit(0.0)
    hits = once(F.lower(_text(text)), lambda low: sum((low.contains(k.lower()).cast("int") for k in keywords), F.lit(0)))
    return F.round(F.least(F.lit(100.0), hits / max(3.0, len(keywords) ** 0.5) * 100), 2)


def compact_summary(summary: Column, title: Column, max_chars: int = 170) -> Column:
    """First sentence without a repeated title, cut at a word."""
    t, head = collapsed(summary), F.concat(collapsed(title), F.lit(":"))
    rest = F.when(F.lower(t).startswith(F.lower(head)) & (F.length(head) > 1), F.trim(F.substr(t, F.length(head) + 1))).otherwise(t)
    first = F.get(F.split(rest, r"(?<=[.!?…])\s+"), F.lit(0))
    cut = F.regexp_replace(F.substring(first, 1, max_chars - 1), r"\s+\S*$", "")
    return F.when(F.length(first) <= max_chars, first).otherwise(F.concat(cut, F.lit("…")))


def fact_fingerprint(text: Column, stop_words: tuple[str, ...] = ("the", "and", "for", "with", "from"), words: int = 10) -> Column:
    """The first words of three or more characters that are not stop words, joined by hyphens."""
    found = F.regexp_extract_all(F.lower(_text(text)), F.lit("[a-zа-яё0-9]{3,}"), F.lit(0))
    return F.array_join(F.slice(F.filter(found, lambda w: ~w.isin(*stop_words)), 1, words), "-")


def plural(n: Column, one: str, few: str, many: str) -> Column:
    """Russian plural form."""
    tens, units = F.pmod(F.abs(n), F.lit(100)), F.pmod(F.abs(n), F.lit(10))
    return F.when((tens >= 11) & (tens <= 14), many).when(units == 1, one).when((units >= 2) & (units <= 4), few).otherwise(many)


def retry_delay(attempts: Column, base: int = 30, cap: int = 1800) -> Column:
    return F.least(F.lit(float(base)) * F.pow(F.lit(2.0), F.greatest(attempts - 1, F.lit(0))), F.lit(float(cap)))


def price_for_model(model: Column, prices: dict[str, tuple[float, float]], default: tuple[float, float]) -> Column:
    """(input, output) rates of the longest prefix of the model's name."""
    out = F.struct(F.lit(default[0]).alias("input"), F.lit(default[1]).alias("output"))
    for prefix in sorted(prices, key=len):
        rate = F.struct(F.lit(prices[prefix][0]).alias("input"), F.lit(prices[prefix][1]).alias("output"))
        out = F.when(model.startswith(prefix), rate).otherwise(out)
    return out
