"""Language identification by compression with per-language dictionaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A dictionary holds at most one excerpt for each bucket of document ids.
BUCKETS = 256
EXCERPT_CHARS = 400
LEVEL = 6
#: Long texts are compressed in pieces of this many characters, so that the dictionary matters throughout.
PIECE = 2000
#: The best language must save this share of the second's size, or the prediction counts as rejected.
MIN_MARGIN = 0.02
UNDETERMINED = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters_only(text: str | None) -> str:
    """Lower-case letters with single spaces; empty if the text is null or has no letter."""
    plain = _NOT_LETTERS.sub(" ", text or "").strip().lower()
    return plain if any(map(str.isalpha, plain)) else ""


def dictionaries(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", buckets: int = BUCKETS, excerpt: int = EXCERPT_CHARS) -> dict[str, bytes]:
    """Raw-content dictionary of each language: distinct excerpts from the middle of a bounded sample.

    Ids are hashed into ``buckets``; in each bucket a language gives the document with the smallest hash
    (combined before the shuffle), so at most ``buckets`` excerpts a language reach the driver however
    large the table is. Null languages and texts without letters teach nothing.
    """
    usable = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    h = F.xxhash64(F.col(id_col).cast("string"))
    length = F.length(text_col)
    start = F.greatest(F.floor((length - excerpt) / 2), F.lit(0)).cast("int") + 1
    rows = usable.select(
        F.col(lang_col).alias("lang"), F.pmod(h, F.lit(buckets)).alias("bucket"), h.alias("h"), F.substring(F.col(text_col), start, F.lit(excerpt)).alias("excerpt")
    )
    best = rows.groupBy("lang", "bucket").agg(F.min(F.struct("h", "excerpt")).alias("best")).collect()
    texts: dict[str, set[str]] = {}
    for r in best:
        texts.setdefault(r["lang"], set()).add(letters_only(r["best"]["excerpt"]))
    return {lang: " ".join(sorted(parts)).encode() for lang, parts in sorted(texts.items())}


class Compressors:
    def __init__(self, content: dict[str, bytes], level: int = LEVEL):
        self.langs = list(content)
        self.all = []
        for data in content.values():
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.all.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False))

    def sizes(self, plain: str) -> np.ndarray:
        """Compressed bytes of the whole text under each language."""
        pieces = [plain[i : i + PIECE].encode() for i in range(0, len(plain), PIECE)]
        return np.array([sum(len(c.compress(p)) for p in pieces) for c in self.all], float)

    def predict(self, text: str | None, min_margin: float) -> tuple[str, float, bool]:
        plain = letters_only(text)
        if not plain or not self.langs:
            return UNDETERMINED, 0.0, True
        size = self.sizes(plain)
        order = np.argsort(size, kind="stable")
        gain = (size - size[order[0]]) / size[order[0]]
        share = np.exp(-50 * gain)
        margin = gain[order[1]] if len(order) > 1 else 1.0
        return self.langs[order[0]], float(1 / share.sum()), bool(margin < min_margin)


def identify(docs: DataFrame, content: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """One row per document: ``doc_id, lang_pred, score, rejected``.

    The language whose dictionary compresses the whole text best wins, the first by name on a tie.
    ``score`` falls from 1 as other languages come near; ``rejected`` marks margins under ``min_margin``.
    Null texts and texts without letters are ``und`` with score 0. With no dictionary all texts are
    ``und``; repeated rows get the same result; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = Compressors(content)
        for batch in batches:
            found = [compressors.predict(t.as_py(), min_margin) for t in batch.column(1)]
            langs, scores, rejected = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                ["doc_id", "lang_pred", "score", "rejected"],
            )

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, lang_pred string, score double, rejected boolean")
