"""Language identification by compression.

Each language has a zstandard raw-content dictionary made of sampled training text. A text is normalised to lower-case
words, cut into blocks, and each block is compressed with every dictionary; the language with the fewest bytes over all
blocks wins. Where the two best totals lie within ``reject_margin`` of each other, the text is encoded again at ``fine_level``,
which also finds the shortest matches; if the margin stays narrow, the text is marked as rejected.

Defined results: a text that is null or has no letter (number signs are none) is ``und`` with score 0 and counts as
rejected; equal totals go to the language with more different training texts, then the smaller name; no training rows at
all make every text ``und``. Repeated rows each give a row, an empty table gives none, and other columns of the input are
neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.words import slices

UND = "und"


@dataclass(frozen=True)
class LanguageIdConfig:
    """Bounds of training: the languages with the most different texts, and for each of them sample_rows texts in expectation,
    their first snippet_chars characters, of which dictionary_bytes go into the dictionary."""

    languages: int = 200
    sample_rows: int = 600
    snippet_chars: int = 1200
    dictionary_bytes: int = 60_000
    block_chars: int = 700
    level: int = 6
    fine_level: int = 19
    reject_margin: float = 0.004


def normalised(texts: pa.Array | list[str | None]) -> list[str]:
    """Runs of letters in lower case (each character by itself), joined by blanks."""
    if isinstance(texts, list):
        texts = pa.array(texts, pa.string())
    return pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"\PL+", " "), " ").to_pylist()


@dataclass
class LanguageModel:
    """languages in order of preference at ties; dictionaries: raw content of each."""

    languages: list[str]
    dictionaries: list[bytes]
    config: LanguageIdConfig = field(default_factory=LanguageIdConfig)

    def compressors(self) -> list[list[zstandard.ZstdCompressor]]:
        """One compressor for each language, at the usual and at the fine level."""
        out = []
        for level in (self.config.level, self.config.fine_level):
            out.append([])
            for content in self.dictionaries:
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=level)
                out[-1].append(zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
        return out

    def predict(self, clean: str, made: list[list[zstandard.ZstdCompressor]]) -> tuple[str, float, float]:
        """Of a normalised text: language, score from 0 to 1, and margin: how much more the runner-up needs, as a part of the best total."""
        if not clean or not self.languages:
            return UND, 0.0, 0.0
        step, best, margin = self.config.block_chars, 0, 1.0
        blocks = [f" {clean[i:i + step]} ".encode() for i in range(0, len(clean), step)]
        for group in made:
            totals = [sum(len(c.compress(b)) for b in blocks) for c in group]
            best = min(range(len(totals)), key=totals.__getitem__)
            if len(totals) == 1:
                break
            margin = (min(t for i, t in enumerate(totals) if i != best) - totals[best]) / totals[best]
            if margin >= self.config.reject_margin:
                break
        return self.languages[best], min(1.0, 0.5 + 2 * margin), margin


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", config: LanguageIdConfig = LanguageIdConfig()) -> LanguageModel:
    """Learns from rows whose text and language are not null. Which texts are sampled depends on their hash alone and shares go
    by different texts, so copies of a text count once."""
    rows = rows.select(F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where("t is not null and l is not null")
    different = rows.select("l", F.xxhash64("t").alias("h")).distinct().groupBy("l").agg(F.count("*").alias("n"))
    counts = {r["l"]: r["n"] for r in different.orderBy(F.col("n").desc(), "l").limit(config.languages).collect()}
    if not counts:
        return LanguageModel([], [], config)
    scale = 1_000_000
    shares = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(scale, config.sample_rows * scale // n + 1))])
    taken = (
        rows.where(F.pmod(F.xxhash64("t"), F.lit(scale)) < shares[F.col("l")])
        .select("l", F.substring("t", 1, config.snippet_chars).alias("t"))
        .groupBy("l", "t").agg(F.min(F.xxhash64("t")).alias("h"))
        .collect()
    )
    taken = sorted(taken, key=lambda r: (r["h"], r["t"]))
    texts: dict[str, list[str]] = {}
    for r, clean in zip(taken, normalised([r["t"] for r in taken])):
        texts.setdefault(r["l"], []).append(clean)
    names = sorted((k for k, v in texts.items() if any(v)), key=lambda k: (-counts[k], k))
    cut = lambda v: " ".join(filter(None, v)).encode()[: config.dictionary_bytes]
    return LanguageModel(names, [b" " + cut(texts[k]) + b" " for k in names], config)


def _scores(model: LanguageModel, text_col: str, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = model.compressors()
        for batch in slices(batches, text_col):
            found = [model.predict(t, made) for t in normalised(batch.column(batch.schema.get_field_index(text_col)))]
            rejected = [lang == UND or margin < model.config.reject_margin for lang, _, margin in found]
            if keep:
                yield batch.filter(pa.array([not x for x in rejected], pa.bool_()))
            else:
                extra = [pa.array([x[i] for x in found], kind) for i, kind in ((0, pa.string()), (1, pa.float64()), (2, pa.float64()))]
                arrays = [c for n, c in zip(batch.schema.names, batch.columns) if n != text_col]
                names = [n for n in batch.schema.names if n != text_col]
                yield pa.RecordBatch.from_arrays([*arrays, *extra, pa.array(rejected, pa.bool_())], [*names, "lang_pred", "score", "margin", "rejected"])

    return run


def classify(docs: DataFrame, model: LanguageModel, id_col: str | Column = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, margin, rejected for each row; one pass, no shuffle."""
    ids = F.col(id_col) if isinstance(id_col, str) else id_col
    slim = docs.select(ids.alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(slim.dtypes)["doc_id"]
    return slim.mapInArrow(_scores(model, "text", False), f"doc_id {kind}, lang_pred string, score double, margin double, rejected boolean")


def keep_accepted(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that the model does not reject."""
    return docs.mapInArrow(_scores(model, text_col, True), docs.schema)
