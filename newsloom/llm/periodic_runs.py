"""Periodic runs of words, found on a Re-Pair grammar of each document.

Re-Pair replaces the most frequent pair of neighbouring symbols by a new one, over and over; the
rest is cut into halves down to single symbols. Every stretch of the text then lies in a lowest
node of this tree and holds words on both sides of that node's boundary. So the runs that cross the
boundary of a nonterminal are computed once, on its first occurrence, and translated to every place
where it is derived; pieces that end at the edge of a node lie within the run of a node above and go
when intervals of equal period are merged.

Work on a document is local to its row: nothing is shuffled and no document meets another.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import map_rows, query, ship, table

#: A run has at least so many words and so many times its period.
LEAST, POWER = 6, 4
#: A pair becomes a nonterminal while it occurs so often; a rule used less often than that saves nothing.
USES = 3
#: Windows up to this length are searched by plain loops, longer ones by arrays.
SHORT = 64


class Grammar:
    """The Re-Pair grammar of a sequence of ids: nonterminals in order of creation, and the rest.

    ``left``, ``right``, ``size``, ``first``: a nonterminal's two parts, its length in words and a
    text position where it is derived. ``starts``, ``symbols``: text positions and symbols of the
    rest. Symbols below ``base`` are ids, ``base + k`` is nonterminal k.
    """

    def __init__(self, ids: list[int], base: int, pairs: Counter | None = None):
        self.base = base
        self.left, self.right, self.size, self.first = [], [], [], []
        n = len(ids)
        seq, after, before = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = Counter(zip(ids, ids[1:])) if pairs is None else pairs
        places = {p: [] for p, c in pairs.items() if c >= USES}
        if places:
            for i, p in enumerate(zip(ids, ids[1:])):
                if p in places:
                    places[p].append(i)
        # Counts in the heap are upper bounds; a pair is counted again when it comes up.
        heap = [(-len(at), p) for p, at in places.items()]
        heapq.heapify(heap)
        while heap:
            bound, pair = heapq.heappop(heap)
            a, b = pair
            at, end = [], -1
            for i in places[pair]:
                j = after[i]
                if i >= end and seq[i] == a and j < n and seq[j] == b:
                    at.append(i)
                    end = after[j]
            if len(at) < USES:
                del places[pair]
                continue
            if len(at) < -bound:
                # Places that overlap others may come back as these are replaced, so they are kept only where a == b.
                if a != b:
                    places[pair] = at
                heapq.heappush(heap, (-len(at), pair))
                continue
            x = base + len(self.left)
            self.left.append(a)
            self.right.append(b)
            self.size.append(self.length(a) + self.length(b))
            self.first.append(at[0])
            del places[pair]
            new = defaultdict(list)
            for i in at:
                j = after[i]
                k = after[j]
                seq[i], seq[j] = x, -1
                after[i] = k
                if k < n:
                    before[k] = i
                    new[(x, seq[k])].append(i)
                h = before[i]
                if h >= 0:
                    new[(seq[h], x)].append(h)
            for p, at in new.items():
                if len(at) >= USES:
                    places[p] = at
                    heapq.heappush(heap, (-len(at), p))
        self.starts, self.symbols, i = [], [], 0
        while i < n:
            self.starts.append(i)
            self.symbols.append(seq[i])
            i = after[i]

    def length(self, symbol: int) -> int:
        return 1 if symbol < self.base else self.size[symbol - self.base]


def same_ahead(a, i: int, j: int, most: int) -> int:
    """How many of the words from ``i`` on equal those from ``j`` on, up to ``most``."""
    done, step = 0, 16
    while done < most:
        k = min(step, most - done)
        differ = a[i + done : i + done + k] != a[j + done : j + done + k]
        at = int(differ.argmax())
        if differ[at]:
            return done + at
        done, step = done + k, step * 4
    return most


def same_behind(a, i: int, j: int, most: int) -> int:
    """How many of the words up to ``i`` equal those up to ``j``, both included, going back."""
    done, step = 0, 16
    while done < most:
        k = min(step, most - done)
        differ = (a[i - done - k + 1 : i - done + 1] != a[j - done - k + 1 : j - done + 1])[::-1]
        at = int(differ.argmax())
        if differ[at]:
            return done + at
        done, step = done + k, step * 4
    return most


def possible_periods(ids: list[int], a, p: int, b: int, e: int, power: int) -> list[tuple[int, bool]]:
    """(period, right) for which two periods beside ``b`` may lie in a run of ``a[p:e]`` that crosses it.

    A run of four periods or more holds two whole ones on one side of the boundary. The word pair
    across the boundary then comes again one period away, and its nearer word two periods away.
    """
    most = (e - p) // power
    r, l = min(most, (e - b) // 2), min(most, (b - p) // 2)
    x, y = ids[b - 1], ids[b]
    if e - p <= SHORT:
        out = [(q, True) for q in range(1, r + 1) if ids[b + q] == y and ids[b + q - 1] == x and ids[b - 1 + 2 * q] == x]
        out += [(q, False) for q in range(1, l + 1) if ids[b - q] == y and ids[b - 1 - q] == x and ids[b - 2 * q] == y]
    else:
        out = []
        if r:
            fits = (a[b + 1 : b + r + 1] == y) & (a[b : b + r] == x) & (a[b + 1 : b + 2 * r : 2] == x)
            out += [(q + 1, True) for q in fits.nonzero()[0].tolist()]
        if l:
            fits = (a[b - l : b] == y)[::-1] & (a[b - 1 - l : b - 1] == x)[::-1] & (a[b - 2 * l : b - 1 : 2] == y)[::-1]
            out += [(q + 1, False) for q in fits.nonzero()[0].tolist()]
    out.sort()
    return out


def crossing_runs(ids: list[int], a, p: int, b: int, e: int, least: int, power: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of the runs within ``a[p:e]`` that hold the words on both sides of ``b``."""
    found = []
    if e - p < least:
        return found
    for q, right in possible_periods(ids, a, p, b, e, power):
        # Two periods of q inside a run of a smaller period: q is no smallest period.
        if any((t - b if right else b - s) >= 2 * q for s, t, _ in found):
            continue
        if right:
            t = b + q + same_ahead(a, b, b + q, e - b - q)
            s = b - same_behind(a, b - 1, b - 1 + q, b - p)
        else:
            t = b + same_ahead(a, b - q, b, e - b)
            s = b - q - same_behind(a, b - 1 - q, b - 1, b - q - p)
        long_enough = t - s >= max(least, power * q)
        if long_enough and s < b < t and not any(u <= s and t <= v for u, v, _ in found):
            found.append((s, t, q))
    return found


def runs_of(words: list, least: int = LEAST, power: int = POWER) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a list of words, by start, then period.

    A run is a stretch of smallest period q and of at least max(least, power * q) words that no
    neighbouring word extends keeping period q; ``power`` is 4 or more. The pair of words across any
    place inside a run occurs three times there, so a text in which no pair does has no rule and no run.
    """
    if power < 4:
        raise ValueError("power below 4: two periods of a run need not lie on one side of a boundary")
    pairs = Counter(zip(words, words[1:]))
    if len(words) < least or not pairs or max(pairs.values()) < USES:
        return []
    import numpy as np

    code = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = [code[w] for w in words]
    a = np.array(ids, dtype=np.int64)
    counts = Counter({(code[x], code[y]): c for (x, y), c in pairs.items() if c >= USES})
    grammar = Grammar(ids, len(code), counts)
    base, out = grammar.base, set()

    # Nonterminals: each boundary once, at its first occurrence; parts come before wholes.
    own: list[list[tuple[int, int, int]]] = []
    busy: list[bool] = []
    for x, y, n, p in zip(grammar.left, grammar.right, grammar.size, grammar.first):
        b = p + grammar.length(x)
        own.append([(s - p, t - p, q) for s, t, q in crossing_runs(ids, a, p, b, p + n, least, power)])
        busy.append(bool(own[-1]) or (x >= base and busy[x - base]) or (y >= base and busy[y - base]))

    # Every place of a nonterminal that has runs, or has them in its parts.
    stack = [(i, x - base) for i, x in zip(grammar.starts, grammar.symbols) if x >= base and busy[x - base]]
    while stack:
        i, k = stack.pop()
        out.update((i + s, i + t, q) for s, t, q in own[k])
        x, y = grammar.left[k], grammar.right[k]
        if x >= base and busy[x - base]:
            stack.append((i, x - base))
        if y >= base and busy[y - base]:
            stack.append((i + grammar.length(x), y - base))

    # The rest, cut into halves. Only boundaries whose word pair is frequent can lie in a run.
    starts = [*grammar.starts, len(ids)]
    often = [0, 0]
    for b in grammar.starts[1:]:
        often.append(often[-1] + ((ids[b - 1], ids[b]) in counts))
    halves = [(0, len(starts) - 1)]
    while halves:
        lo, hi = halves.pop()
        if hi - lo < 2 or starts[hi] - starts[lo] < least or often[hi] == often[lo + 1]:
            continue
        mid = (lo + hi) // 2
        if often[mid + 1] > often[mid]:
            out.update(crossing_runs(ids, a, starts[lo], starts[mid], starts[hi], least, power))
        halves += [(lo, mid), (mid, hi)]

    return merged(out)


def merged(pieces) -> list[tuple[int, int, int]]:
    """(start, length, period) of the pieces (start, end, period) that lie in no other one of their period."""
    runs, period, end = [], None, -1
    for s, t, q in sorted(pieces, key=lambda r: (r[2], r[0], -r[1])):
        if q != period:
            period, end = q, -1
        if t > end:
            runs.append((s, t - s, q))
            end = t
    runs.sort(key=lambda r: (r[0], r[2]))
    return runs


def without_repeats(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    drop = bytearray(len(words))
    for s, n, q in runs:
        drop[s + q : s + n] = b"\x01" * (n - q)
    return [w for w, d in zip(words, drop) if not d]


def find_runs(
    docs: DataFrame, edit: Callable[[int | None, list], list] | None = None, least: int = LEAST, power: int = POWER
) -> DataFrame:
    """doc_id, n_words, runs array<struct<start, length, period>>, collapsed per row of ``docs``.

    Words are runs of anything but ASCII white space. ``runs`` come by start, then period;
    ``collapsed`` is the words left without the repeats of the runs, joined by one space. ``edit``
    may change a document's words first. A null or empty text has no words, no runs and collapses to
    the empty string; equal rows each get their row; a null doc_id stays null; other columns of the
    table are not read, so their names cannot clash.
    """

    def run(batches):
        for b in batches:
            out = {"doc_id": b["doc_id"], "n_words": [], "runs": [], "collapsed": []}
            for doc_id, text in zip(b["doc_id"], b["text"]):
                # Splitting bytes cuts at the six ASCII spaces only.
                words = (text or "").encode().split()
                if edit:
                    words = edit(doc_id, words)
                runs = runs_of(words, least, power)
                out["n_words"].append(len(words))
                out["runs"].append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                out["collapsed"].append(b" ".join(without_repeats(words, runs)).decode())
            yield out

    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), schema, run)


def plant_period(doc_id: int | None, words: list) -> list:
    """The contract's edited words: in one document of ten, by its id's checksum, the tail repeats a stretch."""
    import zlib

    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    at = g % n
    p = 1 + (n - at) // (3 + g % 8)
    unit = words[at : at + p]
    return words[:at] + [unit[i % p] for i in range(n - at)]


def strongest(runs: Column) -> Column:
    """The run of greatest length / period, the first one on ties; compared without division."""
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    return F.reduce(
        runs, none,
        lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best),
    )


@query("op11_periodic_runs")
def op11(spark, sf):
    found = find_runs(table(spark, sf, "documents"), plant_period)
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    return found.withColumn("_top", strongest(F.col("runs"))).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "_top.start", "_top.length", "_top.period",
        F.expr("1000 * _top.length div _top.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


ship(__name__)
