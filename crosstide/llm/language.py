"""Language identification by compression with per-language dictionaries.

For each language a bounded sample of labelled texts, normalised, is the raw
content of its zstandard dictionaries. A text is normalised, cut into pieces of
PIECE_BYTES and compressed with all dictionaries of every language; the language
with the fewest bytes over all pieces wins. Pieces keep a long text from
becoming its own dictionary. Every text, short or long, is measured with the
whole sample. A text is rejected when it has
no letters or when the margin between the two smallest sizes is narrow: below a
share of the smallest size. The share is fitted on the learned texts, between
the margins they have themselves and those of letter-shuffled copies and of
their languages when these are left out. A sole language competes with a
dictionary of its own shuffled letters.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosstide.llm._common import small_batches

#: The sample: documents per language (the least hash in each of so many buckets) and characters of each.
SAMPLE_DOCUMENTS = 128
SAMPLE_CHARS = 1500
#: The sample is dealt over so many dictionaries, so that each learned text can be measured with one that does not hold it.
DICTIONARIES = 2
PIECE_BYTES = 600
LEVEL = 6
#: Bytes by which the second smallest size must exceed the smallest one at least, whatever the fitted share.
REJECT_MARGIN = 1
#: The share is fitted on so many pieces at most; it turns away this part of foreign pieces, but is at most this part of the clean pieces' median.
FIT_PIECES = 2000
FOREIGN_REJECTED, CLEAN_PART = 0.98, 1 / 3
UNKNOWN = "und"

_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def normalise(text: str) -> str:
    """Letters and their marks in lower case, with one space for whatever stands between them; empty without letters."""
    out = _NOT_LETTERS.sub(" ", text.lower()).strip()
    return out if _LETTER.search(out) else ""


def learn(documents: DataFrame, training: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", spread: Column | None = None) -> dict[str, list[bytes]]:
    """Dictionary contents by language, from rows where training holds and text and label are not null.

    Each language's rows are dealt into SAMPLE_DOCUMENTS buckets by a hash of the
    id, and the row of least hash in each bucket is taken: a first pass over ids
    and labels alone finds these hashes, a second fetches their texts. What is
    learned grows with the number of labels alone, by at most SAMPLE_DOCUMENTS *
    SAMPLE_CHARS characters each.
    """
    key = spread if spread is not None else F.xxhash64(F.col(id_col))
    rows = documents.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), key.alias("key"), F.coalesce(training, F.lit(False)).alias("use")).where("use and lang is not null and text is not null")
    chosen = rows.groupBy("lang", F.pmod(F.shiftright("key", 8), F.lit(SAMPLE_DOCUMENTS)).alias("bucket")).agg(F.min("key").alias("key"))
    found = rows.join(F.broadcast(chosen.select("lang", "key")), ["lang", "key"]).groupBy("lang", "key").agg(F.min(F.substring("text", 1, SAMPLE_CHARS * 2)).alias("text")).orderBy("lang", "key").collect()
    out: dict[str, list[str]] = {}
    for r in found:
        out.setdefault(r["lang"], []).append(normalise(r["text"])[:SAMPLE_CHARS])
    dealt = {lang: [f" {' '.join(texts[k::DICTIONARIES])} ".encode() for k in range(DICTIONARIES)] for lang, texts in out.items() if any(texts)}
    # A language of few samples has the same ones in each dictionary, as an empty one would not compress.
    return {lang: [c if c.strip() else max(contents, key=len) for c in contents] for lang, contents in dealt.items()}


@lru_cache(4)
def _compressors(learned: tuple[tuple[str, tuple[bytes, ...]], ...]) -> list[tuple[str, list]]:
    import zstandard

    out = []
    for lang, contents in learned:
        own = []
        for content in contents:
            made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made.precompute_compress(level=LEVEL)
            own.append(zstandard.ZstdCompressor(dict_data=made, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False))
        out.append((lang, own))
    return out


def _shuffled(text: str) -> str:
    """The text with its letters dealt anew; spaces stay."""
    letters = [c for c in text if c != " "]
    random.Random(0).shuffle(letters)
    dealt = iter(letters)
    return "".join(c if c == " " else next(dealt) for c in text)


def with_noise(contents: dict[str, list[bytes]]) -> tuple[tuple[str, tuple[bytes, ...]], ...]:
    """Contents in order of language; a sole language has its shuffled letters beside it as "und"."""
    learned = [(lang, tuple(c)) for lang, c in sorted(contents.items())]
    if len(learned) == 1:
        learned.append((UNKNOWN, tuple(_shuffled(c.decode()).encode() for c in learned[0][1])))
    return tuple(learned)


def narrow_share(learned: tuple[tuple[str, tuple[bytes, ...]], ...]) -> float:
    """The share of the smallest size below which a margin is narrow, fitted on the learned texts.

    Each piece is measured with dictionaries that do not hold it (texts are dealt over
    them). Foreign are shuffled pieces and, with three languages or more, pieces
    measured without their own language.
    """
    own = _compressors(learned)
    each = max(1, FIT_PIECES // max(1, len(learned) * DICTIONARIES))
    clean, foreign = [], []

    def share(sizes: list[tuple[int, str]], lang: str | None = None) -> float:
        (a, first), (b, _) = sorted(sizes)[:2]
        return 0.0 if first == UNKNOWN or lang not in (None, first) else (b - a) / a

    contents_of = {lang: contents for lang, contents in learned if lang != UNKNOWN}
    for lang, contents in contents_of.items() if len(learned) > 1 else ():
        for k, content in enumerate(contents):
            text = content.decode()
            cut = [text[i : i + PIECE_BYTES] for i in range(0, len(text), PIECE_BYTES)]
            step = -(-len(cut) // each)
            for piece in cut[::step]:
                sizes, noise = ([(len(c[(k + 1) % len(c)].compress(t.encode())), name) for name, c in own] for t in (piece, _shuffled(piece)))
                clean.append(share(sizes, lang))
                foreign.append(share(noise))
                if len(sizes) > 2:
                    foreign.append(share([x for x in sizes if x[1] != lang]))
    if not clean:
        return 0.0
    clean.sort()
    foreign.sort()
    most = CLEAN_PART * clean[len(clean) // 2]
    # Shuffled pieces alone say too little of other languages.
    return most if len(contents_of) == 1 else min(foreign[int(FOREIGN_REJECTED * (len(foreign) - 1))], most)


def classify(text: str | None, compressors: list[tuple[str, list]], narrow: float = 0.0) -> tuple[str, float, bool]:
    """(language, score, rejected): the score is 0 at equal sizes and nears 1 as the gap grows."""
    norm = normalise(text or "")
    if not norm or not compressors:
        return UNKNOWN, 0.0, True
    data = f" {norm} ".encode()
    pieces = [data[i : i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)]
    sizes = sorted((sum(len(c.compress(p)) for c in own for p in pieces), lang) for lang, own in compressors)
    if len(sizes) == 1:
        return sizes[0][1], 1.0, False
    margin = sizes[1][0] - sizes[0][0]
    return sizes[0][1], margin / (margin + 8.0), margin < max(REJECT_MARGIN, narrow * sizes[0][0]) or sizes[0][1] == UNKNOWN


def identify(documents: DataFrame, contents: dict[str, list[bytes]], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, kept columns, lang_pred, score, rejected) for every row, from its text alone.

    A text that is null or has no letter is "und" with score 0 and rejected; so is
    every text if nothing was learned. Equal sizes go to the language that sorts
    first and are rejected, as is a margin below the fitted share. Rows that repeat stay; other columns are ignored.
    """
    small_batches(documents.sparkSession)
    chosen = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *keep)
    learned = with_noise(contents)
    narrow = narrow_share(learned)
    names = ["_id", *keep, "lang_pred", "score", "rejected"]
    kinds = dict(chosen.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _compressors(learned)
        for batch in batches:
            out = [classify(t, own, narrow) for t in batch.column(1).to_pylist()]
            lang, score, rejected = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names)

    schema = ", ".join([f"_id {kinds['_id']}", *[f"`{c}` {kinds[c]}" for c in keep], "lang_pred string", "score double", "rejected boolean"])
    return chosen.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
