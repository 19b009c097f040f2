"""Groups of spelling variants by generation over a reduced alphabet.

Letters are hashed to a few symbols. Words one edit apart have reduced words that are equal or one
edit apart, so the one-edit neighbourhood of every reduced word, looked up among the reduced words,
meets all true neighbours and few others; the original strings decide. Over eight symbols the
neighbourhood of a word of ten letters has some hundred members, over the alphabet a thousand.

One edit leaves one half of a word as it was. Words are therefore dealt by either half, as written,
and neighbourhoods are generated where they are looked up: what is shuffled is four short rows a
word, not a row a neighbour. A group, the distinct words of one length with one half in common, is
held once, in some 30 bytes a word and letters; its neighbourhoods come in slices.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import map_rows, query, ship, table
from newsloom.session import materialize

#: Symbols of the reduced alphabet.
SYMBOLS = 8
#: Words count from this many code points and this many occurrences on.
LETTERS, OCCURRENCES = 7, 2
#: A word's form is written at least so many times as often as the word.
TIMES = 10
#: Words counted in a task before the counts are handed on.
HELD = 300_000
#: Rows of whole groups that are searched together; a larger group goes alone.
BLOCK = 100_000
#: Words whose neighbourhoods are generated together.
SLICE = 50_000
#: Base of the keys of reduced words, odd.
BASE = 0x9E3779B97F4A7C15


def misspell(doc_id: int | None, run: str) -> str:
    """The contract's edit: one run of 31, by checksum, loses a code point; a null doc_id counts as empty."""
    import zlib

    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % 31:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, edit=None, letters: int = LETTERS, occurrences: int = OCCURRENCES) -> DataFrame:
    """(word, n) of the words of at least ``letters`` code points that occur ``occurrences`` times or more.

    Words are runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z lower-cased, changed by ``edit``, which never
    adds letters, if given. A null or empty text has none; equal rows all count. Counts combine in the task, then on the map
    side, so a word that every document holds is a row a task.
    """

    def run(batches):
        import re
        from collections import Counter

        # Only letters A-Z change in the lower-casing of bytes.
        runs = re.compile("[a-zÀ-ÿ]+")
        counts: Counter = Counter()

        def rows():
            return {"word": list(counts.keys()), "n": list(counts.values())}

        for b in batches:
            for doc_id, text in zip(b["doc_id"], b["text"]):
                if not text:
                    continue
                for word, n in Counter(runs.findall(text.encode().lower().decode())).items():
                    if edit and len(word) >= letters:
                        word = edit(doc_id, word)
                    if len(word) >= letters:
                        counts[word] += n
                if len(counts) > HELD:
                    yield rows()
                    counts = Counter()
        yield rows()

    found = map_rows(docs.select("doc_id", "text"), "word string, n long", run)
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= occurrences)


def dealt(vocabulary: DataFrame) -> DataFrame:
    """Four rows a word: word, n, size, side, whole, part.

    Pairs are looked for by the length of the longer word, ``size``. For its own length a word stands
    ``whole`` under its left half (side 0) and its right half; for the next length it stands, as the
    shorter word, under what would be the halves there. ``part`` is the group's number.
    """
    m = F.length("word")

    def rows(whole: bool):
        size = m if whole else m + 1
        left = F.floor(size / 2).cast("int")
        right = size - left
        word = F.col("word")
        yield F.struct(size.alias("size"), F.lit(0).alias("side"), F.lit(whole).alias("whole"),
                       F.xxhash64(size, F.lit(0), F.substring(word, F.lit(1), left)).alias("part"))
        yield F.struct(size.alias("size"), F.lit(1).alias("side"), F.lit(whole).alias("whole"),
                       F.xxhash64(size, F.lit(1), F.substring(word, m - right + 1, right)).alias("part"))

    return vocabulary.select("word", "n", F.inline(F.array(*rows(True), *rows(False))))


def letters_of(words: list[str], size: int):
    """Code points of words of one length, a row each."""
    import numpy as np

    return np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), size)


def reduced(letters, symbols: int):
    """Symbols 1 to ``symbols`` of code points, by a multiplicative hash."""
    import numpy as np

    mixed = (letters.astype(np.uint64) * np.uint64(2654435761)) >> np.uint64(7) & np.uint64(0xFFFF)
    return (mixed % np.uint64(symbols)).astype(np.uint8) + np.uint8(1)


def powers(size: int):
    import numpy as np

    out = [np.uint64(1)]
    for _ in range(size):
        out.append(out[-1] * np.uint64(BASE))
    return out


def keys(symbols, part):
    """64-bit keys of reduced words, a polynomial in their symbols that begins with the group's number."""
    import numpy as np

    out = part.astype(np.uint64)
    for j in range(symbols.shape[1]):
        out = out * np.uint64(BASE) + symbols[:, j]
    return out


def slices(symbols, part):
    """(rows, ahead, behind, power) per ``SLICE`` rows: the keys of what lies before and from each position on."""
    import numpy as np

    size = symbols.shape[1]
    power = powers(size)
    for start in range(0, len(symbols), SLICE):
        rows = slice(start, min(start + SLICE, len(symbols)))
        r = symbols[rows]
        ahead, behind = [part[rows].astype(np.uint64)], [np.zeros(len(r), np.uint64)]
        for j in range(size):
            ahead.append(ahead[-1] * np.uint64(BASE) + r[:, j])
            behind.append(behind[-1] + r[:, size - 1 - j].astype(np.uint64) * power[j])
        yield rows, ahead, behind[::-1], power


class Lookup:
    """Rows by their 64-bit keys, sorted."""

    def __init__(self, keys):
        import numpy as np

        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def pairs(self, asked, among):
        """(i, j): the asked keys, numbered by ``among``, and the rows with those keys."""
        import numpy as np

        if not len(self.keys) or not len(asked):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        lo = np.searchsorted(self.keys, asked)
        hit = np.flatnonzero(self.keys[np.minimum(lo, len(self.keys) - 1)] == asked)
        lo, many = lo[hit], np.searchsorted(self.keys, asked[hit], side="right") - lo[hit]
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return np.repeat(among[hit], many), self.order[np.repeat(lo, many) + step]


def one_letter_less(longer, shorter):
    """Whether each row of ``longer`` becomes the row of ``shorter`` by losing one letter."""
    import numpy as np

    before = longer[:, :-1] == shorter
    behind = longer[:, 1:] == shorter
    ahead = np.cumprod(before, axis=1).sum(axis=1)
    return np.cumprod(behind[:, ::-1], axis=1).sum(axis=1) + ahead >= shorter.shape[1]


def near_pairs(words: list[str], short: list[str], part, short_part, size: int, side: int, symbols: int):
    """Pairs one edit apart within the groups of one ``size`` and ``side``: (i, j, same), unique.

    ``words`` have ``size`` letters, ``short`` one less. ``same``: j numbers ``words``, else ``short``.
    A pair is generated from one of its ends, which halves the neighbourhoods and loses none: from
    the word whose changed symbol is smaller, or from the longer one. Edits fall into the half
    that the group does not share.
    """
    import numpy as np

    letters = letters_of(words, size)
    r = reduced(letters, symbols)
    left = size // 2
    places = range(left, size) if side == 0 else range(left)
    with np.errstate(over="ignore"):
        whole = keys(r, part)
        own = Lookup(whole)
        found = []
        i, j = own.pairs(whole, np.arange(len(words)))
        found.append((i[i < j], j[i < j]))
        for rows, ahead, behind, power in slices(r, part):
            for p in places:
                at = r[rows, p].astype(np.uint64)
                for c in range(2, symbols + 1):
                    low = np.flatnonzero(at < c)
                    key = whole[rows][low] + (np.uint64(c) - at[low]) * power[size - 1 - p]
                    i, j = own.pairs(key, rows.start + low)
                    good = (letters[i] != letters[j]).sum(axis=1) == 1
                    found.append((i[good], j[good]))
        i, j = (np.concatenate(x) for x in zip(*found))
        good = (letters[i] != letters[j]).sum(axis=1) == 1
        same = np.unique(np.stack([i[good], j[good]]), axis=1)

        less = np.empty((2, 0), np.int64)
        if short:
            other = letters_of(short, size - 1)
            own, found = Lookup(keys(reduced(other, symbols), short_part)), []
            for rows, ahead, behind, power in slices(r, part):
                for p in places:
                    new = np.arange(rows.stop - rows.start)
                    if p != places[0]:  # losing either of two equal symbols in a row gives one reduced word
                        new = np.flatnonzero(r[rows, p] != r[rows, p - 1])
                    i, j = own.pairs(ahead[p][new] * power[size - 1 - p] + behind[p + 1][new], rows.start + new)
                    good = one_letter_less(letters[i], other[j])
                    if side == 1:  # a pair that shares both halves belongs to the left one
                        good &= (letters[i][:, :left] != other[j][:, :left]).any(axis=1)
                    found.append((i[good], j[good]))
            less = np.unique(np.stack([np.concatenate(x) for x in zip(*found)]), axis=1)
    return (
        np.concatenate([same[0], less[0]]),
        np.concatenate([same[1], less[1]]),
        np.concatenate([np.ones(same.shape[1], bool), np.zeros(less.shape[1], bool)]),
    )


def block_links(rows: dict[str, list], symbols: int) -> dict[str, list]:
    """Links (word, near, near_n), both ways, within whole groups of `dealt` rows."""
    import numpy as np

    word, n, part = rows["word"], rows["n"], np.array(rows["part"], dtype=np.int64)
    kinds: dict[tuple[int, int], tuple[list[int], list[int]]] = {}
    for at, (size, side, whole) in enumerate(zip(rows["size"], rows["side"], rows["whole"])):
        kinds.setdefault((size, side), ([], []))[0 if whole else 1].append(at)
    out: dict[str, list] = {"word": [], "near": [], "near_n": []}
    for (size, side), (own, short) in kinds.items():
        if not own:
            continue
        i, j, same = near_pairs([word[x] for x in own], [word[x] for x in short], part[own], part[short], size, side, symbols)
        for a, b, equal in zip(i.tolist(), j.tolist(), same.tolist()):
            a, b = own[a], own[b] if equal else short[b]
            out["word"] += (word[a], word[b])
            out["near"] += (word[b], word[a])
            out["near_n"] += (n[b], n[a])
    return out


def near_words(vocabulary: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(word, near, near_n): every two words of ``vocabulary`` (word, n) that are one edit apart, both ways.

    An edit is one code point inserted, deleted or replaced. Words are distinct and not null.
    """

    def blocks(batches: Iterator[dict]) -> Iterator[dict]:
        names = ("word", "n", "size", "side", "whole", "part")
        held: dict[str, list] = {x: [] for x in names}
        for b in batches:
            for x in names:
                held[x] += b[x]
            if len(held["part"]) >= BLOCK and held["part"][0] != held["part"][-1]:
                # The last group may go on in the next batch.
                at = len(held["part"])
                while held["part"][at - 1] == held["part"][-1]:
                    at -= 1
                yield {x: held[x][:at] for x in names}
                held = {x: held[x][at:] for x in names}
        yield held

    def run(batches):
        for block in blocks(batches):
            if block["part"]:
                yield block_links(block, symbols)

    placed = dealt(vocabulary).repartition("part").sortWithinPartitions("part")
    return map_rows(placed, "word string, near string, near_n long", run)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms`` (word, form): the last form that forms lead to.

    A form occurs at least ten times as often as its word, so no chain closes or has more than 18
    links; every round halves the chains that are left, and five always end them.
    """
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        now = materialize(now, "spelling-roots")
        further = now.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        joined = now.join(further, F.col("root") == F.col("_w"), "left")
        if joined.filter(F.col("_r").isNotNull()).isEmpty():
            return now
        now = joined.select("word", F.coalesce("_r", "root").alias("root"))


def variants(vocabulary: DataFrame, times: int = TIMES, symbols: int = SYMBOLS) -> DataFrame:
    """word, form, root, n, n_near, form_n per word of ``vocabulary`` (word, n).

    ``form``: the near word of largest n, the smallest in code-point order on ties, if that n is at
    least ``times`` the word's (``times`` above 1); else null. ``root``: the end of the chain of
    forms, the word itself without one. Empty for an empty vocabulary.
    """
    vocabulary = materialize(vocabulary.select("word", "n"), "spelling-words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = near_words(vocabulary, symbols).groupBy(F.col("word").alias("_w")).agg(F.count("*").alias("n_near"), best.alias("best"))
    found = vocabulary.join(near, F.col("word") == F.col("_w"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.col("best.near").alias("_near"), (-F.col("best.less")).alias("_near_n"),
    )
    enough = F.col("_near_n") >= F.lit(times) * F.col("n")
    found = materialize(
        found.select("word", "n", "n_near", F.when(enough, F.col("_near")).alias("form"), F.when(enough, F.col("_near_n")).alias("form_n")),
        "spelling-forms",
    )
    ends = roots(found.filter(F.col("form").isNotNull())).select(F.col("word").alias("_w"), "root")
    return found.join(ends, F.col("word") == F.col("_w"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


@query("op13_spelling_variants")
def op13(spark, sf):
    return variants(word_counts(table(spark, sf, "documents"), misspell))


ship(__name__)
