"""Selectors over the elements of a page: CSS compounds, and the XPath steps that people write for news sites.

CSS: tags, ``*``, ``#id``, ``.class``, attribute tests, descendants, children (``>``) and lists (``,``). XPath: steps by
``/`` and ``//`` with attribute tests, ``contains`` and ``starts-with``. Any other selector is not understood.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from tidewire.functions.markup import Page


class Step(NamedTuple):
    child: bool
    tag: str
    tests: tuple[tuple[str, str, str], ...]


_ATTRIBUTE = r"""\[\s*([\w:-]+)\s*(?:([~^$*|]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]+)))?\s*\]"""
_PART = re.compile(rf"""(?:\#([\w-]+)|\.([\w-]+)|{_ATTRIBUTE})""")
_COMPOUND = re.compile(rf"""([a-zA-Z][\w-]*|\*)?((?:\#[\w-]+|\.[\w-]+|{_ATTRIBUTE})*)""")
_XPATH_STEP = re.compile(r"(//|/)([a-zA-Z][\w-]*|\*)((?:\[[^\]]*\])*)")
_XPATH_TEST = re.compile(r"""\s*(?:@([\w:-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'))?|(contains|starts-with)\(\s*@([\w:-]+)\s*,\s*(?:"([^"]*)"|'([^']*)')\s*\))\s*""")


def _css(text: str) -> list[Step] | None:
    steps: list[Step] = []
    at, child = 0, False
    while at < len(text):
        match = _COMPOUND.match(text, at)
        if match is None or match.end() == at:
            return None
        tests = []
        for part in _PART.finditer(match[2]):
            name, of, attribute, how, *values = part.groups()
            tests.append(("id", "=", name) if name else ("class", "~=", of) if of else (attribute.lower(), how or "", next((v for v in values if v is not None), "")))
        steps.append(Step(child, (match[1] or "*").lower(), tuple(tests)))
        between = re.compile(r"\s*(>)?\s*").match(text, match.end())
        if between.end() == match.end() and between.end() < len(text):
            return None
        at, child = between.end(), between[1] is not None
        if child and at == len(text):
            return None
    return steps or None


def _xpath(text: str) -> list[Step] | None:
    text = text.strip().removeprefix(".")
    steps, at = [], 0
    while at < len(text):
        match = _XPATH_STEP.match(text, at)
        if match is None:
            return None
        tests = []
        for test in re.findall(r"\[([^\]]*)\]", match[3]):
            for one in re.split(r"\band\b", test):
                found = _XPATH_TEST.fullmatch(one)
                if found is None:
                    return None
                name, equal, equal2, how, of, value, value2 = found.groups()
                value, given = (equal if equal is not None else equal2), (value if value is not None else value2)
                tests.append((name.lower(), "" if value is None else "=", value or "") if name else (of.lower(), "*=" if how == "contains" else "^=", given or ""))
        steps.append(Step(match[1] == "/", match[2].lower(), tuple(tests)))
        at = match.end()
    return steps or None


def parse_selector(text: str | None) -> list[list[Step]] | None:
    """Alternatives, each a list of steps; None for one that is empty or not understood."""
    text = (text or "").strip()
    if not text:
        return None
    parsed = [_xpath(text)] if text.startswith(("/", "./")) else [_css(part.strip()) for part in text.split(",")]
    return parsed if all(parsed) else None


def _holds(page: Page, node: int, step: Step) -> bool:
    if step.tag not in ("*", page.tags[node]):
        return False
    found = page.attributes(node) if step.tests else {}
    for name, how, value in step.tests:
        given = found.get(name)
        if given is None:
            return False
        ok = {
            "": True, "=": given == value, "~=": value in given.split(), "^=": bool(value) and given.startswith(value), "$=": bool(value) and given.endswith(value),
            "*=": bool(value) and value in given, "|=": given == value or given.startswith(f"{value}-"),
        }[how]
        if not ok:
            return False
    return True


def select(page: Page, selector: str | None, within: int | None = None) -> list[int]:
    """Elements that a selector picks, in order; of those in the element ``within`` where the selector is relative.

    Steps that are matched so far go down from parents to children as bits, so each element is looked at once.
    """
    parsed = parse_selector(selector)
    if parsed is None:
        return []
    absolute = selector.strip().startswith("/") or within is None
    first, last = (0, len(page.tags) - 1) if absolute else (within, page.last[within])
    picked: set[int] = set()
    for steps in parsed:
        here, above = {}, {}
        for node in range(first, last + 1):
            parent = page.parents[node]
            own_parent, passed = here.get(parent, 0), above.get(parent, 0)
            matched = 0
            for i, step in enumerate(steps):
                if i == 0:
                    reached = not step.child or parent == (-1 if absolute else within)
                else:
                    reached = (own_parent if step.child else passed) >> (i - 1) & 1
                if reached and _holds(page, node, step):
                    matched |= 1 << i
            here[node], above[node] = matched, passed | matched
            if matched >> (len(steps) - 1) & 1:
                picked.add(node)
    return sorted(picked)
