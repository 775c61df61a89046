"""Language identification by compression.

Each language has a zstandard raw-content dictionary of whole documents from a bounded sample of labelled ones. A
text is lower-cased and cut into segments; every segment is compressed once with each dictionary, and the language with the
fewest bytes in all wins. The score is the margin: 1 - fewest / second fewest, 0 to 1. A narrow margin is
a rejection for callers that filter.

Edge cases: a null text or one without a letter is ``und`` with score 0; with no labelled document, or an empty table, every
text is ``und``; with one language its score is 1; ties go to the language with more labelled rows, then to the first in code point order.
Rows whose language or text is null teach nothing; a null id is a value; rows alike in id, language and text teach once. Only
the named columns are read; all others are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .components import map_arrow, quoted

#: Bounds of the fit: documents sampled per language; bytes of whole documents after which a dictionary takes no more of them.
SAMPLE_DOCS, DICTIONARY_BYTES = 400, 112_640
#: Parts in which a language's candidates are ranked first.
_PARTS = 16
#: Characters of a segment: each is compressed on its own, so a dictionary counts along the whole of a long text.
SEGMENT = 4096
#: How hard the compressor searches: matches of three bytes and more, as words are short.
SEARCH = {"compression_level": 3, "window_log": 19, "hash_log": 17, "chain_log": 16, "search_log": 3, "min_match": 3, "target_length": 16, "strategy": zstandard.STRATEGY_LAZY2}
UNKNOWN = "und"


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Raw dictionary content by language, the most frequent first.

    At most SAMPLE_DOCS documents each are picked, on (length, hash of the id, hash of the text) alone, in two rounds, so that
    a frequent language is not ranked in one task; texts are fetched for the picked ones only. A dictionary holds
    the first of them, whole, up to the one that brings it to DICTIONARY_BYTES. Longer documents come last: they teach where
    there is nothing shorter.
    """
    text = F.col(quoted(text_col))
    size = F.octet_length(text)
    keys = {"_long": size > DICTIONARY_BYTES, "_h": F.xxhash64(F.col(quoted(id_col))), "_t": F.xxhash64(text)}
    usable = labelled.filter(F.col(quoted(lang_col)).isNotNull() & text.rlike("\\p{L}"))
    usable = usable.select(F.col(quoted(lang_col)).alias("_lang"), *(c.alias(n) for n, c in keys.items()), size.alias("_size"), text.alias("_text"))
    lean = usable.drop("_text")
    order = [F.col(c) for c in keys]
    part = F.row_number().over(Window.partitionBy("_lang", F.pmod("_t", F.lit(_PARTS))).orderBy(*order))
    every = Window.partitionBy("_lang").orderBy(*order)
    ranked = lean.distinct().withColumn("_n", part).filter(F.col("_n") <= SAMPLE_DOCS).withColumn("_n", F.row_number().over(every)).filter(F.col("_n") <= SAMPLE_DOCS)
    before = F.sum("_size").over(every.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")
    picked = ranked.withColumn("_before", before).filter(F.col("_before") < DICTIONARY_BYTES).drop("_n", "_size", "_before")
    texts = usable.drop("_size").join(F.broadcast(picked), ["_lang", *keys]).groupBy("_lang", *keys).agg(F.min("_text").alias("_text"))  # picked: SAMPLE_DOCS rows a language
    seen = {lang: n for lang, n in lean.groupBy("_lang").count().collect()}
    out = {lang: b"" for lang in sorted(seen, key=lambda lang: (-seen[lang], lang))}
    for lang, *_, sample in sorted(texts.collect()):
        out[lang] += sample.lower().encode() + b"\n"
    return out


class Classifier:
    """Compressed sizes of texts under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = list(dictionaries)
        parameters = zstandard.ZstdCompressionParameters(**SEARCH, write_content_size=0, write_checksum=0, write_dict_id=0)
        self.compressors = []
        for lang in self.langs:
            content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=parameters)
            self.compressors.append(zstandard.ZstdCompressor(compression_params=parameters, dict_data=content).compress)

    def sizes(self, text: str) -> list[int]:
        out, text = [0] * len(self.langs), text.lower()
        for i in range(0, len(text), SEGMENT):
            part = text[i : i + SEGMENT].encode()
            for k, compress in enumerate(self.compressors):
                out[k] += len(compress(part))
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        if len(self.langs) == 1:
            return self.langs[0], 1.0
        (best, k), (second, _), *_ = sorted((n, k) for k, n in enumerate(self.sizes(text)))
        return self.langs[k], 1 - best / second


def predict_documents(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """All rows and columns of docs plus the two named ones, which replace any so named; predictions see the text alone."""
    kept = docs.select(*(F.col(quoted(c)) for c in docs.columns if c == text_col or c not in (lang_name, score_name)))
    at = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(dictionaries)
        for batch in batches:
            found = [classifier.predict(x.as_py()) for x in batch.column(at)]
            columns = [*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [*kept.columns, lang_name, score_name]
    return map_arrow(kept, run, T.StructType([*kept.schema, T.StructField(lang_name, T.StringType()), T.StructField(score_name, T.DoubleType())]))


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """Whether crc32 of the id as text falls into the fold kept for evaluation; a null id does not."""
    return F.coalesce(F.crc32(F.col(quoted(id_col)).cast("string").cast("binary")) % folds == fold, F.lit(False))


def confident(docs: DataFrame, min_score: float, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows whose language is found with a margin of min_score at least, unchanged.

    Learns from the labelled rows of docs outside the held-out fold.
    """
    dictionaries = fit(docs.filter(~held_out(id_col)), id_col, text_col, lang_col)
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    found = predict_documents(plain, dictionaries, f"c{docs.columns.index(text_col)}", "found", "margin")
    return found.filter((F.col("found") != UNKNOWN) & (F.col("margin") >= min_score)).drop("found", "margin").toDF(*docs.columns)
