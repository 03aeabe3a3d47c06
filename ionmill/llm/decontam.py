"""Operator 9: benchmark decontamination by template windows.

Text becomes a sequence of words, case-folded (in scripts without spaces each character is one), and of canonical words: numbers (whole, with commas and points), units after a number, and names turn into
typed placeholders. Any capitalised word may be a name; one that opens a sentence counts as a plain word where it is unchanged, and as a differing word
where it would contradict the names inside sentences. Every run of ``window`` words is a window; items with fewer words are one window of their own length. The windows of all
benchmark items, literal ones and template ones, form two hash tables that each task joins its documents' windows with. Matches of a document and an item are
aligned (document position minus item position); an alignment counts when its windows cover at least ``coverage`` of the item's words.

Literal windows: kind ``verbatim``, whatever the item's words are. Template windows: kind ``template``, when ``least_plain`` of the item's words are no
placeholders and the slots are consistent: each value in the benchmark stands for one value in the document and the other way round, per type. So a
question with other numbers and names is found, and chance matches of placeholders are not.

The benchmark is the stated query set. It goes to the tasks in blocks of ``block_windows`` windows at most (or one item), each met by all
documents, so no more than a block is ever broadcast. Documents are not shuffled.

Rows of ``matches``: one per input row and item. Nulls: null text or item text matches nothing; a null doc_id is carried. Texts of items that
are equal match alike. Repeated rows match alike. An empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens
from .wordhash import Words, mix, window_hashes

_SEPARATOR, _STOP = ".,", ".!?\n\r:;|。！？；：．｡؟۔।॥…"
#: Scripts without spaces: each of their characters is a word.
_SPACELESS = [(0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x3029), (0x3031, 0x30FF), (0x3105, 0x312F), (0x31A0, 0x31FF), (0x3400, 0xA4CF), (0xA980, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x16FE0, 0x18DFF), (0x1AFF0, 0x1B2FF), (0x20000, 0x3347F)]
_END = 0x33480  # no letters from here
_IS_WORD, _IS_DIGIT, _IS_UPPER, _IS_ALONE, _IS_SEPARATOR, _IS_STOP = (np.uint8(1 << k) for k in range(6))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Classes, and hash values of the case-folded character, by code point; the last entry is for all above."""
    classes, folded = np.zeros(_END + 1, np.uint8), np.arange(_END + 1, dtype=np.uint64)
    for k in range(_END):
        kind = unicodedata.category(x := chr(k))
        if kind[0] in "LMN":
            classes[k] = _IS_WORD | (_IS_DIGIT if kind == "Nd" else 0) | (_IS_UPPER if kind in ("Lu", "Lt") else 0)
            if len(low := x.casefold()) == 1:
                folded[k] = ord(low)
    for low, high in _SPACELESS:
        classes[low:high + 1] |= np.where(classes[low:high + 1] & (_IS_WORD | _IS_DIGIT) == _IS_WORD, _IS_ALONE, np.uint8(0))
    for chars, bit in ((_SEPARATOR, _IS_SEPARATOR), (_STOP, _IS_STOP)):
        classes[[ord(x) for x in chars]] |= bit
    return classes, mix(folded + np.uint64(1))


_CLASSES, _VALUES = _tables()
#: Characters that become several when their case is folded, like the sharp s.
_WIDE = re.compile("[" + "".join(chr(k) for k in range(128, _END) if len(chr(k).casefold()) > 1) + "]")


def _narrow(text: str) -> str:
    if text.isascii():
        return text
    return _WIDE.sub(lambda m: m[0].casefold().capitalize() if m[0].isupper() else m[0].casefold(), text)


class Runes(Words):
    """Words by code point: letters, marks and digits; commas and points between digits belong to the number."""

    def __init__(self, texts: list[str]):
        texts = [_narrow(t) for t in texts]
        self.data = "\n".join([*texts, ""])
        self.raw = np.minimum(np.frombuffer(self.data.encode("utf-32-le", "replace"), "<u4"), _END)
        self.classes = _CLASSES[self.raw]
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        inside, digit, alone = ((self.classes & x) > 0 for x in (_IS_WORD, _IS_DIGIT, _IS_ALONE))
        inside[1:-1] |= ((self.classes[1:-1] & _IS_SEPARATOR) > 0) & digit[:-2] & digit[2:]
        apart = ~inside | alone
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= apart[:-1] | alone[1:]
        ends[:-1] &= apart[1:] | alone[:-1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, bounds)
        self.hashes = self._hash(self.raw, _VALUES)


#: Units that turn into a placeholder after a number.
UNITS = "mm cm m km mg g kg t ml l s sec min h hr hrs minutes seconds hours days weeks months years mph kmh w kw kwh v a hz khz mhz ghz kb mb gb tb usd eur gbp dollars euros pounds cents percent inches feet miles yards ounces gallons litres liters metres meters degrees"
NUMBER, NAME, UNIT = (np.uint64(x) for x in (0x1111111111111111, 0x2222222222222222, 0x3333333333333333))
MATCH = "doc_id long, item_id long, kind string, covered double, position long, slots long"


_UNIT_HASHES = np.sort(Runes([UNITS]).hashes)


class Canonical:
    """Canonical words of a batch: codes per word, 0 in ``kinds`` for plain words, else 1 number, 2 name, 3 unit, 4 possible name (capitalised, opens a sentence)."""

    def __init__(self, texts: list[str]):
        self.words = w = Runes(texts)
        n = len(w.starts)
        self.kinds = kinds = np.zeros(n, np.uint8)
        if n:
            lead = w.classes[w.starts]
            upper = (lead & _IS_UPPER) > 0
            stops = np.concatenate([[0], np.cumsum(w.classes & _IS_STOP > 0, dtype=np.int64)])
            opens = np.ones(n, bool)
            opens[1:] = stops[w.starts[1:]] > stops[w.ends[:-1]]
            opens[w.first[:-1][w.first[:-1] < n]] = True
            kinds[upper] = np.where(opens, 4, 2)[upper]
            kinds[(lead & _IS_DIGIT) > 0] = 1
            unit = np.zeros(n, bool)
            unit[1:] = (kinds[:-1] == 1) & ~opens[1:]
            at = np.searchsorted(_UNIT_HASHES, w.hashes)
            unit &= (at < len(_UNIT_HASHES)) & (_UNIT_HASHES[np.minimum(at, len(_UNIT_HASHES) - 1)] == w.hashes)
            kinds[unit] = 3
        self.codes = np.where(kinds == 0, w.hashes, np.array([0, NUMBER, NAME, UNIT, NAME], np.uint64)[kinds])

    def slot(self, k: int) -> tuple[int, str]:
        kind = int(self.kinds[k])
        return 2 if kind == 4 else kind, self.words.data[self.words.starts[k]:self.words.ends[k]].casefold()


class Index:
    """Windows of items, sorted by hash."""

    def __init__(self, codes: list[np.ndarray], window: int):
        self.lengths = np.array([min(len(x), window) for x in codes], np.int64)
        hashes, owner, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, x in enumerate(codes):
            if len(x):
                hashes.append(mix(window_hashes(x, int(self.lengths[k])) ^ np.uint64(self.lengths[k])))
                owner.append(np.full(len(hashes[-1]), k))
                place.append(np.arange(len(hashes[-1])))
        flat, owner, place = np.concatenate(hashes), np.concatenate(owner), np.concatenate(place)
        order = np.lexsort((place, owner, flat))
        self.hashes, self.owner, self.place = flat[order], owner[order], place[order]
        #: Places of an item that repeat a window, by (item, first place); filled by fold().
        self.again: dict[tuple[int, int], list[int]] = {}

    def fold(self) -> Index:
        """Keep the first place of a window that an item repeats, so that repeats in a text do not meet all of them; ``again`` has the places."""
        new = np.ones(len(self.hashes), bool)
        new[1:] = (self.hashes[1:] != self.hashes[:-1]) | (self.owner[1:] != self.owner[:-1])
        heads = np.flatnonzero(new)
        for a, b in zip(heads, [*heads[1:], len(new)], strict=True):
            if b - a > 1:
                self.again[int(self.owner[a]), int(self.place[a])] = self.place[a:b].tolist()
        self.hashes, self.owner, self.place = self.hashes[new], self.owner[new], self.place[new]
        return self

    def hits(self, codes: np.ndarray, first: np.ndarray) -> dict[int, dict[int, list[tuple[int, int]]]]:
        """(position in the text, position in the item) of equal windows, by text and item."""
        out: dict = defaultdict(lambda: defaultdict(list))
        for length in np.unique(self.lengths[self.lengths > 0]):
            got = mix(window_hashes(codes, int(length)) ^ np.uint64(length))
            low = np.searchsorted(self.hashes, got)
            found = np.flatnonzero((low < len(self.hashes)) & (self.hashes[np.minimum(low, len(self.hashes) - 1)] == got))
            text = np.searchsorted(first, found, "right") - 1
            whole = found + length <= first[text + 1]
            for at, t in zip(found[whole].tolist(), text[whole].tolist(), strict=True):
                k = int(low[at])
                while k < len(self.hashes) and self.hashes[k] == got[at]:
                    if self.lengths[self.owner[k]] == length:
                        out[t][int(self.owner[k])].append((at - int(first[t]), int(self.place[k])))
                    k += 1
        return out


class Block:
    """Some benchmark items: windows of their literal words, and template windows of items with ``least_plain`` plain words."""

    def __init__(self, items: list[tuple[int, str]], window: int, least_plain: float):
        self.ids = [i for i, _ in items]
        c = Canonical([t for _, t in items])
        spans = list(zip(c.words.first[:-1], c.words.first[1:], strict=True))
        self.sizes = np.diff(c.words.first)
        self.slots = [{int(k - a): c.slot(k) for k in range(a, b) if c.kinds[k]} for a, b in spans]
        self.opens = [{int(k - a) for k in range(a, b) if c.kinds[k] == 4} for a, b in spans]
        self.least_plain = least_plain
        self.literal = Index([c.words.hashes[a:b] for a, b in spans], window).fold()
        varied = [bool(x) and size - len(x) + len(y) >= least_plain * size for x, y, size in zip(self.slots, self.opens, self.sizes, strict=True)]
        self.template = Index([c.codes[a:b] if v else c.codes[:0] for (a, b), v in zip(spans, varied, strict=True)], window)


def runs(pairs: list[tuple[int, int]], drift: int = 4) -> list[list[tuple[int, int]]]:
    """Pairs by alignment. drift: words by which neighbours may shift within one."""
    pairs = sorted(pairs, key=lambda p: (p[0] - p[1], p[0]))
    out = [[pairs[0]]]
    for p in pairs[1:]:
        if (p[0] - p[1]) - (out[-1][-1][0] - out[-1][-1][1]) > drift:
            out.append([])
        out[-1].append(p)
    return out


def copied(block: Block, item: int, pairs: list[tuple[int, int]], coverage: float) -> tuple | None:
    """("verbatim", covered, position, slots) of the best alignment of literal windows."""
    length, best = int(block.literal.lengths[item]), None
    for run in runs(pairs):
        met = Counter(q for _, q in run)
        places = {p for q, n in met.items() for p in block.literal.again.get((item, q), (q,))[:n]}  # a repeated window counts as often as it is met
        covered = len({q + k for q in places for k in range(length)}) / int(block.sizes[item])
        if covered >= coverage and (best is None or covered > best[1]):
            best = ("verbatim", covered, min(d for d, _ in run), len({v for k, v in block.slots[item].items() if k not in block.opens[item] and any(k - x in places for x in range(length))}))
    return best


def judge(block: Block, item: int, pairs: list[tuple[int, int]], c: Canonical, base: int, coverage: float) -> tuple | None:
    """("template", covered, position, slots) of the best alignment that counts."""
    length, size, slots, opens = int(block.template.lengths[item]), int(block.sizes[item]), block.slots[item], block.opens[item]
    best = None
    for run in runs(pairs):
        if len({q + k for _, q in run for k in range(length)}) < coverage * size:
            continue
        shifts: dict[int, set[int]] = defaultdict(set)
        for d, q in run:
            shifts[d - q].update(range(q, q + length))
        for main in sorted(shifts, key=lambda x: (-len(shifts[x]), x)):
            got = _filled(shifts, main, slots, opens, c, base)
            if got is None:
                continue
            words, changed, values = got
            if len(words) >= coverage * size and size - len(slots) + len(opens) - changed >= block.least_plain * size:
                if best is None or len(words) / size > best[1]:
                    best = ("template", len(words) / size, min(d for d, _ in run), values)
                break
    return best


def _filled(shifts: dict[int, set[int]], main: int, slots: dict, opens: set[int], c: Canonical, base: int) -> tuple[set[int], int, int] | None:
    """(item words, changed openings, slot values) of an alignment grown from one shift; None when the slots of ``main`` are not consistent.

    A shift next to it adds the words that are still open, unless its slots contradict. A word that opens a sentence may be no name: where it
    contradicts, it is a differing word.
    """
    there: dict = {}
    back: dict = {}
    words: dict[int, int] = {}
    for shift in sorted(shifts, key=lambda x: (abs(x - main), x)):
        new = sorted(shifts[shift] - words.keys())
        a, b = dict(there), dict(back)
        if all(a.setdefault(x := slots[q], y := c.slot(base + q + shift)) == y and b.setdefault(y, x) == x for q in new if q in slots and q not in opens):
            there, back = a, b
            words |= dict.fromkeys(new, shift)
        elif shift == main:
            return None
    values, changed = set(there), 0
    for q in sorted(opens & words.keys()):
        x, y = slots[q], c.slot(base + q + words[q])
        if there.get(x, y) != y or back.get(y, x) != x:
            del words[q]
        elif x != y:
            there[x], back[y] = y, x
            values.add(x)
            changed += 1
    return set(words), changed, len(values)


def blocks(benchmark: DataFrame, window: int, least_plain: float, block_windows: int) -> Iterator[Block]:
    held: list[tuple[int, str]] = []
    n = 0
    for r in benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator():
        held.append((r.item_id, r.text))
        n += len(Runes([r.text]).starts)
        if n >= block_windows:
            yield Block(held, window, least_plain)
            held, n = [], 0
    if held:
        yield Block(held, window, least_plain)


def _judged(texts: list[str], block: Block, coverage: float) -> dict[int, list[tuple]]:
    """(item_id, kind, covered, position, slots) by text."""
    out: dict[int, list[tuple]] = {}
    for a, b in tokens.in_slices(texts, 1_000_000):
        c = Canonical(texts[a:b])
        first = c.words.first
        same, alike = block.literal.hits(c.words.hashes, first), block.template.hits(c.codes, first)
        for t in sorted({*same, *alike}):
            mine, other = same.get(t, {}), alike.get(t, {})
            for item in sorted({*mine, *other}):
                got = copied(block, item, mine[item], coverage) if item in mine else None
                if got is None and item in other:
                    got = judge(block, item, other[item], c, int(first[t]), coverage)
                if got:
                    out.setdefault(a + t, []).append((block.ids[item], *got))
    return out


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 8, coverage: float = 0.75, least_plain: float = 0.5, block_windows: int = 2_000_000) -> DataFrame:
    """MATCH rows of all documents and items."""
    spark, out = docs.sparkSession, None
    narrow = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    for block in blocks(benchmark, window, least_plain, block_windows):
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator, held=held) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
                rows = [(ids[t], *m) for t, ms in _judged(texts, held.value, coverage).items() for m in ms]
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
                cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in MATCH.split(", ")])

        got = common.map_arrow(narrow, run, MATCH)
        out = got if out is None else out.unionByName(got)
    return out if out is not None else spark.createDataFrame([], MATCH)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 8, coverage: float = 0.75, least_plain: float = 0.5, block_windows: int = 2_000_000) -> DataFrame:
    """The rows of ``docs``, all columns, that match no item."""
    names, out = docs.columns, docs
    at = names.index("text")
    for block in blocks(benchmark, window, least_plain, block_windows):
        held = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator, held=held) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                texts = [t or "" for t in batch.column(at).to_pylist()]
                bad = _judged(texts, held.value, coverage)
                yield batch.filter(pa.array([k not in bad for k in range(len(texts))], pa.bool_()))

        out = common.map_arrow(out, run, docs.schema)
    return out
