"""Runs of repeated words: a Re-Pair grammar of the word ids, runs across each rule's boundary, and their places in the text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has at least so many words, and at least so many periods.
LEAST, PERIODS = 6, 4
#: Pairs found less often make no rule: a run of four periods holds each of its pairs three times.
OFTEN = 3
#: Bytes of text whose grammars are made together, unless one text alone is longer.
TOGETHER = 2 << 20
#: Pairs of places compared at once.
COMPARED = 1 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    h = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


class Grammar:
    """Re-Pair over sequences of symbols; sequences share no symbol.

    `place, width, symbol, joined` describe what is left of the sequences: `joined` is whether a run may cross
    from a symbol to the next one. Rules have a left and a right symbol, the width of the left one, their own
    width, and the first place of the text that they derive; rule r is symbol `terminals + r`.
    """

    def __init__(self, ids: np.ndarray, ends: np.ndarray):
        self.ids, self.terminals = ids, len(ids)
        n = len(ids)
        joined = np.ones(n, bool)
        joined[ends[ends > 0] - 1] = False
        keep = np.ones(n, bool)
        for _ in range(2):  # pairs are counted anew among what the first pass leaves
            joined, keep = self._trimmed(joined, keep)
        at = np.flatnonzero(keep)
        self.symbol, self.place, self.width, self.joined = ids[at].astype(np.int64), at, np.ones(len(at), np.int64), joined[at]
        self.rules = np.zeros((0, 5), np.int64)  # left, right, left's width, width, place
        self._known, self._known_rule = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._repair()

    def _trimmed(self, joined: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cut where a rare pair stands, then leave out what is too short for a run. No run crosses a cut."""
        at = np.flatnonzero(joined)
        if len(at):
            _, which, many = np.unique(self.ids[at] * np.int64(self.terminals) + self.ids[at + 1], return_inverse=True, return_counts=True)
            joined = joined.copy()
            joined[at[many[which] < OFTEN]] = False
        edge = np.flatnonzero(~joined)
        size = np.diff(np.append(-1, edge))
        keep = np.repeat(size >= LEAST, size)
        return joined & keep, keep

    def _repair(self) -> None:
        """Replace pairs until none is found often enough: in each round every pair that is more frequent than its neighbours."""
        live = self.joined.copy()
        symbols = 2 * self.terminals + 1
        while True:
            at = np.flatnonzero(live)
            if not len(at):
                return
            pairs, which, many = np.unique(self.symbol[at] * symbols + self.symbol[at + 1], return_inverse=True, return_counts=True)
            often = many[which] >= OFTEN
            live[at[~often]] = False  # a pair only grows rarer, and so do those made from its symbols
            at, which = at[often], which[often]
            if not len(at):
                return
            rank = np.empty(len(pairs), np.int64)
            rank[np.lexsort((_mixed(pairs), many))] = np.arange(len(pairs))
            mine = rank[which]
            near = np.diff(at) == 1
            opens = np.append(True, ~(near & (mine[1:] == mine[:-1])))  # a symbol beside itself: every second pair
            begin = np.flatnonzero(opens)
            stretch = np.cumsum(opens) - 1
            over_left, over_right = np.append(True, ~near | (mine[1:] > mine[:-1])), np.append(~near | (mine[:-1] > mine[1:]), True)
            last = np.append(begin[1:], len(at)) - 1
            best = (over_left[begin] & over_right[last])[stretch]
            chosen = best & ((np.arange(len(at)) - begin[stretch]) % 2 == 0)
            self._replace(at[chosen], pairs[which[chosen]], live)
            keep = np.ones(len(live), bool)
            keep[at[chosen] + 1] = False
            live = self._compacted(live, keep)

    def _replace(self, at: np.ndarray, pair: np.ndarray, live: np.ndarray) -> None:
        new, first = np.unique(pair, return_index=True)
        new, first = new[~np.isin(new, self._known)], first[~np.isin(new, self._known)]
        i = at[first]
        rule = np.arange(len(self.rules), len(self.rules) + len(new))
        self.rules = np.concatenate([self.rules, np.stack([self.symbol[i], self.symbol[i + 1], self.width[i], self.width[i] + self.width[i + 1], self.place[i]], 1)])
        known, of = np.append(self._known, new), np.append(self._known_rule, rule)
        order = np.argsort(known)
        self._known, self._known_rule = known[order], of[order]
        self.symbol[at] = self.terminals + self._known_rule[np.searchsorted(self._known, pair)]
        self.width[at] += self.width[at + 1]
        live[at], self.joined[at] = live[at + 1], self.joined[at + 1]

    def _compacted(self, live: np.ndarray, keep: np.ndarray) -> np.ndarray:
        self.symbol, self.place, self.width, self.joined = self.symbol[keep], self.place[keep], self.width[keep], self.joined[keep]
        return live[keep]

    def boundaries(self) -> tuple[np.ndarray, np.ndarray]:
        """(rule, or -1 for a place of its own; from, boundary, to): every rule once, and what is left as balanced trees."""
        wide = np.flatnonzero(self.rules[:, 3] >= LEAST) if len(self.rules) else np.zeros(0, np.int64)
        r = self.rules[wide]
        nodes = [np.stack([r[:, 4], r[:, 4] + r[:, 2], r[:, 4] + r[:, 3]], 1)]
        if len(self.symbol):
            opens = np.append(True, ~self.joined[:-1])
            begin = np.flatnonzero(opens)
            many = np.diff(np.append(begin, len(opens)))
            first = np.repeat(begin, many)
            k = np.arange(len(opens)) - first
            inner = np.flatnonzero(k > 0)
            k, first, many = k[inner], first[inner], np.repeat(many, many)[inner]
            half = k & -k
            end = first + np.minimum(k + half, many) - 1
            tree = np.stack([self.place[first + k - half], self.place[inner], self.place[end] + self.width[end]], 1)
            nodes.append(tree[tree[:, 2] - tree[:, 0] >= LEAST])
        return np.append(wide, np.full(sum(map(len, nodes[1:])), -1)), np.concatenate(nodes)

    def occurrences(self) -> tuple[np.ndarray, np.ndarray]:
        """(rule, place) of every node of the derivation that is wide enough for a run, ordered by rule."""
        rule, place = self.symbol - self.terminals, self.place
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(rule):
            wide = rule >= 0
            wide[wide] = self.rules[rule[wide], 3] >= LEAST
            rule, place = rule[wide], place[wide]
            found.append((rule, place))
            of = self.rules[rule]
            rule, place = np.concatenate([of[:, 0], of[:, 1]]) - self.terminals, np.concatenate([place, place + of[:, 2]])
        rule, place = (np.concatenate(x) for x in zip(*found)) if found else (rule, place)
        order = np.argsort(rule, kind="stable")
        return rule[order], place[order]


def _same(ids: np.ndarray, i: int, j: int, most: int, step: int) -> int:
    """How many symbols from i and j on (backward with step -1) are equal, up to `most`."""
    done, size = 0, 32
    while done < most:
        k = min(size, most - done)
        if step > 0:
            differs = ids[i + done : i + done + k] != ids[j + done : j + done + k]
        else:
            differs = ids[i - done - k + 1 : i - done + 1][::-1] != ids[j - done - k + 1 : j - done + 1][::-1]
        at = int(differs.argmax())
        if differs[at]:
            return done + at
        done += k
        size *= 8
    return most


def _candidates(ids: np.ndarray, nodes: np.ndarray, right: bool) -> Iterator[tuple[int, int]]:
    """(node, period) in order, where the first symbols beside the boundary agree with those a period away."""
    periods = (nodes[:, 2] - nodes[:, 0]) // PERIODS
    room = ((nodes[:, 2] - nodes[:, 1]) if right else (nodes[:, 1] - nodes[:, 0])) // 2
    periods = np.minimum(periods, room)
    total = np.cumsum(periods)
    a = 0
    while a < len(nodes):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + COMPARED, "right")))
        node = np.repeat(np.arange(a, b), periods[a:b])
        q = np.arange(len(node)) - np.repeat(np.cumsum(periods[a:b]) - periods[a:b], periods[a:b]) + 1
        for t in range(8):
            here = nodes[node, 1] + t if right else nodes[node, 1] - 1 - t
            fits = q <= t
            some = ~fits
            fits[some] = ids[here[some]] == ids[here[some] + (q[some] if right else -q[some])]
            node, q = node[fits], q[fits]
        yield from zip(node.tolist(), q.tolist())
        a = b


def _crossing(ids: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """`node, from, to, period` of the maximal runs inside each node that have two periods on a side of its boundary.

    A multiple of a period inside the stretch that has the period says nothing new, so it is passed over.
    """
    out: set[tuple[int, int, int, int]] = set()
    for right in (True, False):
        now, passed = -1, 0
        for k, q in _candidates(ids, nodes, right):
            if k != now:
                now, passed = k, 0
                lo, p, hi = nodes[k].tolist()
            if q <= passed:
                continue
            if right:
                ahead = _same(ids, p, p + q, hi - p - q, 1)
                if ahead < q:
                    continue
                a, b = p - _same(ids, p - 1, p + q - 1, p - lo, -1), p + q + ahead
                passed = b - p - q
            else:
                back = _same(ids, p - 1, p - 1 - q, p - q - lo, -1)
                if back < q:
                    continue
                a, b = p - q - back, p + _same(ids, p, p - q, hi - p, 1)
                passed = p - a - q
            if b - a >= max(LEAST, PERIODS * q):
                out.add((k, a, b, q))
    return np.array(sorted(out), np.int64).reshape(-1, 4)


def _maximal(runs: np.ndarray, n: int) -> np.ndarray:
    """`from, to, period` without what lies inside another of the same period, and each stretch with its smallest period."""
    if not len(runs):
        return runs
    runs = runs[np.lexsort((-runs[:, 1], runs[:, 0], runs[:, 2]))]
    _, period = np.unique(runs[:, 2], return_inverse=True)
    reach = np.maximum.accumulate(runs[:, 1] + period * (n + 1))
    runs = runs[np.append(True, runs[1:, 1] + period[1:] * (n + 1) > reach[:-1])]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.append(True, (runs[1:, :2] != runs[:-1, :2]).any(1))
    runs = runs[new]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def find_runs(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """`from, to, period`, by start and period, of all runs in sequences of symbols that end at `ends` and share no symbol."""
    grammar = Grammar(ids, ends)
    rule, nodes = grammar.boundaries()
    found = _crossing(ids, nodes)
    if not len(found):
        return np.zeros((0, 3), np.int64)
    of = rule[found[:, 0]]
    own = found[of < 0][:, 1:]
    ruled, of = found[of >= 0], of[of >= 0]
    derived, place = grammar.occurrences()
    lo, hi = np.searchsorted(derived, of, "left"), np.searchsorted(derived, of, "right")
    many = hi - lo
    which = np.repeat(np.arange(len(of)), many)
    spot = place[np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)]
    shift = spot - nodes[ruled[which, 0], 0]
    moved = np.stack([ruled[which, 1] + shift, ruled[which, 2] + shift, ruled[which, 3]], 1)
    return _maximal(np.concatenate([own, moved]), len(ids))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut by bytes of text: TOGETHER at most, or one text."""
    for batch in batches:
        size = np.array([len(x.as_buffer()) for x in batch["text"]], np.int64)
        a = 0
        while a < len(size):
            b = max(a + 1, a + int(np.searchsorted(np.cumsum(size[a:]), TOGETHER, "right")))
            yield batch.slice(a, b - a)
            a = b


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id, n_words, runs, collapsed` of every row.

    A run is a stretch of words with a smallest period q (words q apart are equal) of at least six words and four
    periods that cannot be made longer with that period. `runs` has `start, length, period` of each, by start and
    period; `collapsed` has the words, joined by one space, without those that a run holds after its first q.
    Words stand between ASCII white space and are compared unchanged.

    The words of a text are numbered and compressed by Re-Pair; a run lies across the boundary of the lowest rule
    that derives it, so each rule's boundary is searched once, what is found goes to all places that the rule
    derives, and stretches that others of their period hold are left out.

    Null and empty texts have no words and no runs. Repeated rows have equal results, and ids, null ones too, are
    only carried. A text is searched in one task with about 100 bytes a word, so a very long text needs its
    multiple in memory. No rows give no rows; other columns are unused.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            words = [t.as_buffer().to_pybytes().split() for t in batch["text"]]
            many = np.array([len(w) for w in words], np.int64)
            ends = np.cumsum(many)
            ids = [pa.array(w, pa.binary()).dictionary_encode().indices.to_numpy() for w in words]
            starts = ends - many  # a text has no more different words than words: its ids begin where it begins
            flat = np.concatenate([i + s for i, s in zip(ids, starts)]).astype(np.int64)
            runs = find_runs(flat, ends) if len(flat) else np.zeros((0, 3), np.int64)
            doc = np.searchsorted(ends, runs[:, 0], "right")
            gone = np.zeros(len(flat) + 1, np.int64)
            np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
            np.add.at(gone, runs[:, 1], -1)
            kept = np.cumsum(gone)[:-1] == 0
            whole = np.bincount(doc, minlength=len(many)) == 0
            collapsed = [b" ".join(w) if all_ else b" ".join([w[i] for i in np.flatnonzero(kept[s:e])]) for w, all_, s, e in zip(words, whole.tolist(), starts.tolist(), ends.tolist())]
            at = np.searchsorted(doc, np.arange(len(many) + 1))
            each = pa.StructArray.from_arrays([pa.array(runs[:, 0] - starts[doc]), pa.array(runs[:, 1] - runs[:, 0]), pa.array(runs[:, 2])], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(many), pa.ListArray.from_arrays(pa.array(at, pa.int32()), each), pa.array(collapsed, pa.binary())], ["id", "n_words", "runs", "collapsed"])

    out = rows.mapInArrow(search, f"id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary")
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))
