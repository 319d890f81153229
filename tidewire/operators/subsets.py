"""Links of small sets, counted by the subsets that sets share and not pair by pair.

Two sets of a and b elements are similar from t(a, b) shared elements on. How many sets of b elements share at least t
with a set is, by inclusion and exclusion, the sum over its subsets of j >= t elements of (-1)^(j-t) * C(j-1, t-1)
times the number of sets of b elements that hold the subset. A subset is counted where its rarest element is: there
go all sets that have the element, with their more frequent ones. Only subsets that several sets hold are grown, so
time grows with the number of sets and of shared subsets, not with that of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators.tables import bounded_batches

#: sets of an element from which its subsets are parted by their second rarest element too
HOT = 20_000
#: sets that one task takes with all their elements, about
PART = 4096
#: rows that are looked at together, about, and subsets that are grown at once
ROWS, GROWN = 1 << 16, 1 << 18


class Rule:
    """``least[a, b]``: shared elements from which sets of a and b elements are similar (0: none suffice); ``signs[j]``: what a subset of j elements counts."""

    def __init__(self, most: int, threshold: float):
        sizes = range(most + 1)
        enough = lambda a, b: next((s for s in range(1, min(a, b) + 1) if s / (a + b - s) >= threshold), 0)
        self.least = np.array([[enough(a, b) for b in sizes] for a in sizes])
        self.signs = [np.array([[(-1) ** (j - t) * comb(j - 1, t - 1) if 0 < t <= j else 0 for t in row] for row in self.least.tolist()], "float64") for j in sizes]
        #: elements that a set of each size shares with any similar one at least
        self.need = np.array([min((t for t in row if t), default=most + 1) for row in self.least.tolist()])


def held_elements(sets: DataFrame, rule: Rule, elements: str = "stems") -> DataFrame:
    """(depth, k1, k2, of, copies, n, rest): each set at each of its elements with the more frequent ones, as far as these can suffice.

    At an element of more than ``HOT`` sets ``k1``, a set stands at each pair with a more frequent ``k2`` (depth 2) and, for
    the element alone, at k2 = -1 without more.
    """
    single = sets.select("of", "copies", F.size(elements).alias("n"), F.explode(elements).alias("k"))
    rarity = single.groupBy("k").agg(F.count("*").alias("df"))
    ranked = single.join(rarity, "k").groupBy("of", "copies", "n").agg(F.array_sort(F.collect_list(F.struct("df", "k"))).alias("ranked"))
    at = ranked.select("of", "copies", "n", "ranked", F.posexplode("ranked").alias("p", "x"))
    rest = at.select("of", "copies", "n", "x", F.slice("ranked.k", F.col("p") + 2, F.col("n")).alias("rest"))
    none = F.array().cast("array<long>")
    place = lambda depth, k2, more: F.struct(F.lit(depth).alias("depth"), k2.cast("long").alias("k2"), more.alias("rest"))
    alone = F.array(place(1, F.lit(-1), none))
    parted = F.concat(alone, F.transform("rest", lambda k, i: place(2, k, F.slice("rest", i + 2, F.col("n")))))
    places = rest.select("of", "copies", "n", F.col("x.k").alias("k1"), F.explode(F.when(F.col("x.df") > HOT, parted).otherwise(F.array(place(1, F.lit(-1), F.col("rest"))))).alias("s"))
    need = F.element_at(F.array(*(F.lit(int(x)) for x in rule.need[1:])), F.col("n"))
    return places.where(F.col("s.depth") + F.size("s.rest") >= need).select("s.depth", "k1", "s.k2", "of", "copies", "n", "s.rest")


class Group:
    """Rows of some elements: ``n`` elements of each set, ``copies``, and the codes of its more frequent elements from ``begin`` to ``end``."""

    def __init__(self, rule: Rule, key: np.ndarray, n: np.ndarray, copies: np.ndarray, sizes: np.ndarray, codes: np.ndarray):
        self.rule, self.n, self.copies = rule, n, copies.astype("float64")
        self.begin = np.cumsum(sizes) - sizes
        self.end = self.begin + sizes
        self.names, self.codes = np.unique(codes, return_inverse=True)
        self.key = key
        self.links, self.linked, self.best = np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n))

    def run(self, depth: int) -> None:
        """Counts all subsets; those of one piece of the pile are held at once."""
        pile = [(depth, self._count(depth, np.arange(len(self.n)), self.key, self.begin))]
        while pile:
            j, (row, subset, at) = pile.pop()
            more = self.end[row] - at
            if more.sum() > GROWN and subset.any():
                order = np.argsort(subset, kind="stable")
                part = np.cumsum(more[order]) // GROWN
                edge = np.flatnonzero(np.diff(subset[order])) + 1  # all rows of a subset stay together
                edge = edge[part[edge] > part[edge - 1]]
                if len(edge):
                    for piece in np.split(order, edge):
                        piece.sort()
                        pile.append((j, (row[piece], np.unique(subset[piece], return_inverse=True)[1], at[piece])))
                    continue
            if more.sum():
                pile.append((j + 1, self._count(j + 1, *self._grown(j, row, subset, at, more))))

    def _grown(self, j: int, row: np.ndarray, subset: np.ndarray, at: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        element = np.repeat(at - (np.cumsum(more) - more), more) + np.arange(more.sum())
        row, subset = np.repeat(row, more), np.repeat(subset, more)
        able = j + self.end[row] - element >= self.rule.need[self.n[row]]
        row, subset, element = row[able], subset[able], element[able]
        return row, np.unique(subset * len(self.names) + self.codes[element], return_inverse=True)[1], element + 1

    def _count(self, j: int, row: np.ndarray, subset: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Adds what subsets of j elements tell; gives those that several sets hold."""
        held = np.bincount(subset) > 1
        some = held[subset]
        row, at, subset = row[some], at[some], (np.cumsum(held) - 1)[subset[some]]
        if not len(row):
            return row, subset, at
        a, width, signs = self.n[row], len(self.rule.need), self.rule.signs[j]
        cell, size = subset * width + a, (int(subset.max()) + 1) * width
        many, copies = (np.bincount(cell, weights, size).reshape(-1, width) for weights in (None, self.copies[row]))
        own = signs[a, a]
        for out, held, self_ in ((self.links, many, own), (self.linked, copies, own * self.copies[row])):
            out += np.bincount(row, (held @ signs.T)[subset, a] - self_, len(out))
        # the smallest other set that holds the subset tells the greatest overlap
        first = (many > 0).argmax(1)
        again = many.copy()
        again[np.arange(len(many)), first] -= 1
        second = (again > 0).argmax(1)
        b = np.where(first[subset] == a, second[subset], first[subset])
        starts = np.flatnonzero(np.diff(row, prepend=-1))  # rows are in order
        at_row = row[starts]
        self.best[at_row] = np.maximum(self.best[at_row], np.maximum.reduceat(j / (a + b - j), starts))
        return row, subset, at


def _counted(rule: Rule):
    columns = ("depth", "k1", "k2", "of", "copies", "n")

    def told(parts: list[dict]) -> Iterator[pa.RecordBatch]:
        x = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
        x["codes"] = np.concatenate([p["codes"] for p in parts])
        new = np.zeros(len(x["of"]), bool)
        for c in ("depth", "k1", "k2"):
            new |= np.diff(x[c], prepend=x[c][0]) != 0
        group = Group(rule, np.cumsum(new), x["n"].astype("int64"), x["copies"], x["sizes"], x["codes"])
        group.run(int(x["depth"][0]))
        some = group.best > 0
        yield pa.RecordBatch.from_arrays([pa.array(x["of"][some].astype("int64")), *(pa.array(v[some].astype("int64")) for v in (group.links, group.linked)), pa.array(group.best[some])], names=["of", "links", "linked", "best"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            x = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in columns}
            x["sizes"] = batch.column("rest").value_lengths().to_numpy(zero_copy_only=False).astype("int64")
            codes, ends = batch.column("rest").flatten().to_numpy(zero_copy_only=False), np.cumsum(x["sizes"])
            changes = np.zeros(batch.num_rows, bool)
            for c in ("depth", "k1", "k2"):
                before = held[-1][c][-1] if held else x[c][0]
                changes |= np.diff(x[c], prepend=before) != 0
            deeper = np.diff(x["depth"], prepend=held[-1]["depth"][-1] if held else x["depth"][0]) != 0
            begin, rows = 0, sum(len(p["of"]) for p in held)
            for i in np.flatnonzero(changes).tolist():  # rows of one element are looked at together
                if rows + i - begin >= ROWS or deeper[i]:
                    if i > begin:
                        held.append({k: v[begin:i] for k, v in x.items()} | {"codes": codes[ends[begin] - x["sizes"][begin] : ends[i - 1]]})
                    yield from told(held)
                    held, begin, rows = [], i, 0
            held.append({k: v[begin:] for k, v in x.items()} | {"codes": codes[ends[begin] - x["sizes"][begin] :]})
        if held:
            yield from told(held)

    return run


def subset_links(sets: DataFrame, *, most: int, threshold: float) -> DataFrame:
    """Rows of (of, links, linked, best) to be summed (best: the greatest) by ``of``: similar sets, their copies, the greatest overlap.

    ``sets``: of, copies, stems (distinct, at most ``most``). Set by set the sums are exact; single rows are parts of them and may be
    negative. A set with ``links`` of 0 has no similar one, whatever ``best`` is.
    """
    bounded_batches(sets.sparkSession)
    rule = Rule(most, threshold)
    parts = sets.count() // PART + 1
    held = held_elements(sets, rule).repartition(parts, "k1", "k2").sortWithinPartitions("depth", "k1", "k2")
    return held.mapInArrow(_counted(rule), "of long, links long, linked long, best double")
