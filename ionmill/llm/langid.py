"""Operator 5: language identification by compression.

Each language has a zstandard raw-content dictionary made of labelled text. A text is compressed whole, in blocks of ``BLOCK`` bytes, with every dictionary and
belongs to the language whose dictionary makes the sum smallest. What a dictionary saves is bounded, so without blocks the start of a long text
would decide and the margin would shrink with the length; so each block has the same say. When the smallest and the second size lie within ``reject_margin`` of each other, the
prediction stands but the document is marked as rejected. Texts are lower-cased and everything but letters becomes one space, so that
decoration says nothing.

Fitting reads a bounded sample of labelled rows: per language the ``sample_docs`` different rows with the least hash of (doc_id, text) among those of at most
``sample_chars`` characters, each whole. Labels may be wrong, so each half of a language's sample is first judged with dictionaries of the
other halves and what they put elsewhere is left out. Everything else covers all rows: prediction reads whole texts.

Nulls and ties: null text, or text without a letter (digits, signs, fractions and superscripts are none), is ``und`` with score 0 and rejected. Equal sizes are settled by the sum of sizes over
``tie_levels``, then by language name. Without any labelled text every prediction is ``und``. Rows: one per input row; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}").search
UNKNOWN = "und"
#: Bytes of normalised text that are compressed at once.
BLOCK = 1 << 16


def normal(text: str) -> str:
    return _OTHER.sub(" ", text.lower()).strip()


def held_out(doc_id: Column) -> Column:
    """The fold that is never learnt from: crc32 of doc_id as text, mod 4, equal to 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Compressors:
    """One compressor per language, at one level."""

    def __init__(self, dictionaries: dict[str, bytes], level: int):
        import zstandard as zs

        self.by_lang = {}
        for lang, data in sorted(dictionaries.items()):
            held = zs.ZstdCompressionDict(data, dict_type=zs.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=level)
            self.by_lang[lang] = zs.ZstdCompressor(dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)

    def sizes(self, data: bytes) -> dict[str, int]:
        blocks = [data[k:k + BLOCK] for k in range(0, len(data), BLOCK)]
        return {lang: sum(len(c.compress(b)) for b in blocks) for lang, c in self.by_lang.items()}


class Model:
    """Dictionaries per language. Small enough to travel with the tasks: languages x sample_docs texts of at most sample_chars characters."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = 5, tie_levels: tuple[int, ...] = (1, 3, 9), reject_margin: float = 0.001):
        self.dictionaries, self.level, self.tie_levels, self.reject_margin = dictionaries, level, tie_levels, reject_margin
        self._made: dict[int, Compressors] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_made": {}}

    def _at(self, level: int) -> Compressors:
        if level not in self._made:
            self._made[level] = Compressors(self.dictionaries, level)
        return self._made[level]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected). Score: how much smaller the best size is than the second, as a share of what could be."""
        plain = normal(text or "")
        if not _LETTER(plain) or not self.dictionaries:
            return UNKNOWN, 0.0, True
        data = plain.encode("utf-8", "replace")
        sizes = self._at(self.level).sizes(data)
        if len(sizes) == 1:
            return next(iter(sizes)), 1.0, False
        order = sorted(sizes, key=lambda k: (sizes[k], k))
        if sizes[order[0]] == sizes[order[1]]:
            tied = [k for k in order if sizes[k] == sizes[order[0]]]
            more = [self._at(level).sizes(data) for level in self.tie_levels]
            tied.sort(key=lambda k: (sum(m[k] for m in more), k))
            gap = sum(m[tied[1]] - m[tied[0]] for m in more) / sum(m[tied[1]] for m in more)
            return tied[0], max(0.0, gap), gap < self.reject_margin
        gap = 1 - sizes[order[0]] / sizes[order[1]]
        return order[0], gap, gap < self.reject_margin


def least(draws: DataFrame, most: int, fan: int = 16) -> DataFrame:
    """lang, draw, place (from 1) of the ``most`` least draws per language; ``draws`` holds different (lang, draw) rows.

    ``fan`` slices of the partitions are ranked first, and only their least go on: a language that most rows share is spread over that many tasks,
    and the last ranking meets at most fan * most rows of it, however many there are. The slices are no part of the result.
    """
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("draw"))
    sliced = draws.withColumn("slice", F.spark_partition_id() % fan)
    some = sliced.withColumn("place", first("lang", "slice")).where(F.col("place") <= most).select("lang", "draw")
    return some.withColumn("place", first("lang")).where(F.col("place") <= most)


def fit(docs: DataFrame, sample_docs: int = 120, sample_chars: int = 20_000, **settings) -> Model:
    """Learn from (doc_id, text, lang); rows without lang or text are no use. The driver gets sample_docs rows per language."""
    draw = F.xxhash64("doc_id", "text")
    usable = docs.where((F.col("lang").isNotNull()) & (F.length("text") <= sample_chars)).select("lang", draw.alias("draw"), "text")
    chosen = least(usable.select("lang", "draw").distinct(), sample_docs)
    found = usable.join(F.broadcast(chosen), ["lang", "draw"]).groupBy("lang", "place").agg(F.first("text").alias("text")).collect()
    sample: dict[str, list[bytes]] = {}
    for r in sorted(found, key=lambda r: (r.lang, r.place)):
        if _LETTER(text := normal(r.text)):
            sample.setdefault(r.lang, []).append(text.encode("utf-8", "replace"))
    level = settings.get("level", 5)
    halves = [Compressors({k: b" ".join(v[f::2]) for k, v in sample.items() if len(v) > f}, level) for f in (0, 1)]
    clean = {}
    for lang, texts in sample.items():
        agreed = []
        for k, text in enumerate(texts):
            sizes = halves[1 - k % 2].sizes(text)
            if lang not in sizes or min(sizes, key=lambda x: (sizes[x], x)) == lang:
                agreed.append(text)
        clean[lang] = b" ".join(agreed or texts)
    return Model(clean, **settings)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected per row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            got = [model.predict(t.as_py()) for t in batch.column(1)]
            lang, score, rejected = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return common.map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "text"), run, "doc_id long, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is not rejected."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array([not model.predict(t.as_py())[2] for t in batch.column(at)], pa.bool_()))

    return common.map_arrow(docs, run, docs.schema)
