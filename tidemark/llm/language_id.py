"""Language identification by compression.

For each language a bounded sample of labelled texts is one zstandard
raw-content dictionary. A text, as its lower-case words, is compressed with
every dictionary, in pieces so that the dictionary stays in reach of all of a
long text, and the language of the smallest total wins. The score is the relative margin over the second
language, stretched to 0..1; narrow margins are rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.llm.common import releasing, small_or_not, written

#: Bound of the sample: bytes of one language's dictionary and of all, and rows
#: of one language's sample. There may be any number of languages; beyond
#: TOTAL_BYTES / DICTIONARY_BYTES of them each has an equal, smaller part.
DICTIONARY_BYTES, TOTAL_BYTES = 256 << 10, 16 << 20
SAMPLE_ROWS = 400
#: Longest text in a sample, so that a dictionary holds many texts; of languages
#: with only longer ones, so many characters of a text.
SAMPLE_CHARS = 6000
#: Bytes of a text that are compressed at once.
PIECE_BYTES = 4096
LEVEL = 6
#: Appended to pieces shorter than SHORT_BYTES: a block of a few bytes would be
#: stored, whatever its matches, so this one has literals that compress. It is
#: random over 26 symbols that no dictionary holds.
SHORT_BYTES = 256


def _anchor(length: int = 80, symbols: int = 26) -> bytes:
    x, out = 1, []
    for _ in range(length):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(33 + (x >> 16) % symbols)
    return bytes(out)


ANCHOR = _anchor()
#: Least margin of the smallest size over the second; narrower is rejected.
LEAST_MARGIN = 0.01
#: Margin with score one half.
HALF_MARGIN = 0.05
UNKNOWN = "und"
#: Pieces of a language, and their bytes, that measure what short dictionaries lack.
CALIBRATION_PIECES, CALIBRATION_BYTES = 16, 1024
MOST_PIECES = 1024
#: Characters that are no letters or marks, and marks, which re counts among them.
BARE = re.compile(r"[\W\d_]+")
MARK = regex.compile(r"\p{M}")
BARE_OF_MARKED = regex.compile(r"[^\p{L}\p{M}]+")


def held_out(doc_id: Column) -> Column:
    """Whether crc32(doc_id as text) mod 4 is 2. A null id: of the empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 4 == 2


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """Dictionaries by language from labelled rows.

    The sample holds, for each language, of the SAMPLE_ROWS distinct texts of
    1 to SAMPLE_CHARS characters with the smallest hashes as many as fill its
    dictionary. A language's rate follows from its count, so the window sorts a
    few times SAMPLE_ROWS rows of it, not all. Nulls, and texts without letters,
    are left out; repeated texts count once; ties of hashes go to the smaller
    text. Extra columns are not read; an empty table gives no dictionaries. The
    driver gets TOTAL_BYTES at most, and the languages' names."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).filter("text is not null and lang is not null and text rlike '\\\\p{L}'")
    rows = rows.withColumn("h", F.xxhash64("text", F.lit(7)))
    short = F.length("text") <= SAMPLE_CHARS
    counts = written(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(short.cast("long")).alias("n_short")), "language-counts")
    languages = counts.count()
    if not languages:
        return {}
    size = min(DICTIONARY_BYTES, max(1, TOTAL_BYTES // languages))
    # half of the rows may be copies of others
    share = 4.0 * SAMPLE_ROWS / F.when(F.col("n_short") > 0, F.col("n_short")).otherwise(F.col("n"))
    bound = F.when(share >= 1, F.lit(2**63 - 1)).otherwise(((F.least(share, F.lit(1 - 2.0**-20)) - 0.5) * 2.0**64).cast("long"))
    bounds = counts.select(F.col("lang").alias("_lang"), bound.alias("bound"), (F.col("n_short") > 0).alias("has_short"))
    near = rows.join(small_or_not(bounds), F.col("lang") == F.col("_lang")).filter(F.col("h") <= F.col("bound")).filter(short | ~F.col("has_short"))
    near = near.select("lang", "h", F.substring("text", 1, SAMPLE_CHARS).alias("text")).groupBy("lang", "h").agg(F.min("text").alias("text"))
    first = Window.partitionBy("lang").orderBy("h")
    before = first.rowsBetween(Window.unboundedPreceding, -1)
    sample = near.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= SAMPLE_ROWS)
    sample = sample.withColumn("filled", F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0))).filter(F.col("filled") < size)
    pieces: dict[str, list[bytes]] = {}
    for r in sample.select("lang", "nth", F.encode("text", "UTF-8").alias("text")).orderBy("lang", "nth").collect():
        pieces.setdefault(r["lang"], []).append(words(bytes(r["text"]).decode("utf-8", "replace")))
    # each its own size: shortness() corrects for what a shorter one lacks
    return {name: b"\n".join(texts)[:size] for name, texts in sorted(pieces.items())}


def words(text: str) -> bytes:
    """UTF-8 of a text in lower case, each run of other than letters and marks
    being one space: case, markup and numbers tell no language."""
    text = f" {text.lower()} "
    bare = BARE_OF_MARKED if not text.isascii() and MARK.search(text) else BARE
    return bare.sub(" ", text).encode("utf-8", "surrogatepass")


def packer(dictionary: bytes, size: int) -> zstandard.ZstdCompressor:
    """A compressor with a dictionary, repeated to size bytes: zstandard's own
    parameters depend on the size."""
    full = dictionary * (-(-size // max(1, len(dictionary))))
    d = zstandard.ZstdCompressionDict(full[len(full) - size :], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


def shortness(dictionaries: dict[str, bytes]) -> dict[str, float]:
    """For each language the factor, 1 for the longest dictionaries, by which
    the size of its dictionary alone lengthens what it compresses.

    A long dictionary helps texts of other languages too, by names and common
    syllables. How much is measured on the longest one, whole and cut to each
    size, with pieces of all other languages; what a text has in common with
    its own language's words is not corrected away."""
    size = max(map(len, dictionaries.values()), default=0)
    longest = next((k for k in sorted(dictionaries) if len(dictionaries[k]) == size), None)
    if all(len(v) == size for v in dictionaries.values()):
        return dict.fromkeys(dictionaries, 1.0)
    each = max(1, min(CALIBRATION_PIECES, MOST_PIECES // len(dictionaries)))
    pieces = [v[at : at + CALIBRATION_BYTES] for k, v in sorted(dictionaries.items()) if k != longest for at in range(0, min(len(v), each * CALIBRATION_BYTES), CALIBRATION_BYTES)][:MOST_PIECES]

    def total(length: int) -> int:
        p = packer(dictionaries[longest][:length], size)
        return sum(len(p.compress(x + ANCHOR)) - len(ANCHOR) for x in pieces)

    # measured at powers of two, and between them by the logarithm
    lengths = [*(1 << i for i in range(size.bit_length()) if 1 << i < size), size]
    whole = max(1, total(size))
    factors = [max(1.0, total(n) / whole) for n in lengths[:-1]] + [1.0]
    return {k: float(np.interp(np.log2(max(1, len(v))), np.log2(lengths), factors)) for k, v in dictionaries.items()}


class Classifier:
    """Compressors with each language's dictionary, and its factor."""

    def __init__(self, dictionaries: dict[str, bytes], factors: dict[str, float] | None = None) -> None:
        self.names = sorted(dictionaries)
        size = max(map(len, dictionaries.values()), default=0)
        factors = factors if factors is not None else shortness(dictionaries)
        self.factors = [factors[name] for name in self.names]
        self.packers = [packer(dictionaries[name], size) for name in self.names]

    def sizes(self, data: bytes) -> list[float]:
        """Compressed bytes by language, without the anchor's and corrected for
        short dictionaries."""
        pieces = [data[i : i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)]
        extra = [ANCHOR if len(x) < SHORT_BYTES else b"" for x in pieces]
        added = sum(map(len, extra))
        return [max(1, sum(len(p.compress(x + y)) for x, y in zip(pieces, extra, strict=True)) - added) / f for p, f in zip(self.packers, self.factors, strict=True)]

    def best(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and acceptance of a whole text; ties go to the
        first name."""
        if text is None or not self.names or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, False
        if len(self.names) == 1:
            return self.names[0], 1.0, True
        sizes = self.sizes(words(text))
        at = min(range(len(sizes)), key=lambda i: (sizes[i], i))
        second = min(s for i, s in enumerate(sizes) if i != at)
        margin = (second - sizes[at]) / second if second else 0.0
        return self.names[at], margin / (margin + HALF_MARGIN), margin >= LEAST_MARGIN


def predict(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text") -> DataFrame:
    """docs with lang_pred, score and accepted added; only text is read.

    A null text, or one without letters, is `und` with score 0, not accepted.
    Repeated texts get equal results; own columns of these names are replaced."""
    fields = ["lang_pred", "score", "accepted"]
    docs = docs.drop(*fields)
    factors = shortness(dictionaries)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(dictionaries, factors)
        for batch in batches:
            found = [model.best(t.as_py()) for t in batch.column(text)]
            columns = [*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *fields])

    return docs.mapInArrow(releasing(run), schema)


def identify(docs: DataFrame) -> DataFrame:
    """Predictions for all docs by a model of those not held out.

    A null text, or one without letters, is `und` with score 0; of equal sizes
    the first name wins; repeated rows keep a row each, with equal results; a
    null id is held out by the empty text's hash. Without labelled rows all are
    `und`. Extra columns are not read; an empty table gives no rows."""
    model = learn(docs.filter(~held_out(F.col("doc_id"))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return predict(rows, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")
