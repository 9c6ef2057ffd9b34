"""Language identification by compression.

Per language a raw-content zstandard dictionary is built from excerpts of
training documents. A text is compressed once with each language's
dictionary, and the language with the smallest output is chosen: text that
shares letter sequences with the dictionary compresses best. When the two
smallest sizes are within ``MARGIN`` of each other (relative), the verdict is
rejected as too narrow.

On both sides letters are lower-cased and anything between them is one space, so
that capitals, digits, signs and markup neither break nor make matches.
Texts are compressed whole, in pieces of ``PIECE`` bytes, so that the
dictionary counts for the later parts of a long text as much as for the
first; sizes are summed over the pieces.

Fitting uses a bounded sample: about ``SAMPLE`` documents per language, those
with the smallest content hash, chosen by a hash threshold that a count per
language sets (one small aggregation, one filter; nothing is sorted). Each
gives an excerpt of ``EXCERPT`` characters, so a dictionary has at most about
SAMPLE * EXCERPT characters. The dictionaries travel with the task closure.

Edge cases: null text or text without a letter: ``und``, score 0, not
accepted; ties go to the language first by code point; documents without
language never train; with no training documents at all every verdict is
``und``; an empty table gives an empty result; repeated rows are judged alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sample_by_hash

SAMPLE = 400       # training documents per language, about
EXCERPT = 400      # characters taken from each
LEVEL = 3          # zstandard level
PIECE = 8192       # bytes compressed at a time
MARGIN = 0.01      # relative difference of sizes below which a verdict is rejected
UNDETERMINED = "und"
NOT_LETTERS = r"[^\p{L}\p{M}]+"     # a run of these counts as one space


def fit(labelled: DataFrame, sample: int = SAMPLE, excerpt: int = EXCERPT) -> dict[str, bytes]:
    """Raw dictionary content per language from rows (text, lang)."""
    rows = labelled.where(F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", "text")
    start = F.pmod(F.xxhash64("text"), F.greatest(F.length("x") - excerpt, F.lit(1))).cast("int") + 1
    got = (sample_by_hash(rows, F.col("lang"), sample, F.col("text"))
           .select("lang", "text", F.trim(F.regexp_replace(F.lower("text"), NOT_LETTERS, " ")).alias("x"))
           .select("lang", F.substring(F.col("x"), start, F.lit(excerpt)).alias("x")).where("x <> ''")
           .groupBy("lang").agg(F.array_join(F.sort_array(F.collect_set("x")), " ").alias("x")).collect())
    return {r["lang"]: r["x"].encode() for r in got}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        import regex
        import zstandard as z

        self.letter = regex.compile(r"\p{L}").search
        self.words = regex.compile(NOT_LETTERS).sub
        self.models = []
        for lang in sorted(dictionaries, key=lambda s: s.encode()):
            d = z.ZstdCompressionDict(dictionaries[lang], dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            c = z.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False)
            self.models.append((lang, c.compress))
        self.overhead = {lang: len(f(b"")) for lang, f in self.models}

    def sizes(self, text: str) -> list[tuple[int, str]]:
        data = self.words(" ", text.lower()).strip().encode()
        pieces = [data[i:i + PIECE] for i in range(0, len(data), PIECE)]
        return [(sum(len(f(p)) - self.overhead[lang] for p in pieces), lang) for lang, f in self.models]

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, accepted)."""
        if not text or not self.models or not self.letter(text):
            return UNDETERMINED, 0.0, False
        sizes = self.sizes(text)
        best, lang = min(sizes, key=lambda x: x[0])
        if len(sizes) == 1:
            return lang, 1.0, True
        second = sorted(s for s, _ in sizes)[1]
        margin = 1 - best / second if second > 0 else 0.0
        # a margin of a few percent is already decisive: 0.5 at none, towards 1
        return lang, 1 - 0.5 * math.exp(-40 * max(margin, 0.0)), margin >= MARGIN


def identify(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """doc_id, lang_pred, score, accepted of every text."""
    schema = "doc_id bigint, lang_pred string, score double, accepted boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Classifier(dictionaries)
        for batch in batches:
            out = [judge(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in out], pa.string()),
                 pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], pa.bool_())],
                names=["doc_id", "lang_pred", "score", "accepted"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
