"""Language identification by compression with per-language dictionaries."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.llm.common import importable

#: The bound of what is learnt from: documents of each language, characters of each document, characters of all languages (but LEAST of each document).
DOCS, CHARS, ALL_CHARS, LEAST = 128, 1500, 32_000_000, 64
#: Columns of the trigrams' table; coders that a worker keeps.
GRAMS, CODERS = 4096, 64
#: Bytes compressed at a time, so that the dictionary matters at every place of a long text; the level.
STEP, LEVEL = 1024, 6
#: Gain over the second language, relative, below which a prediction is marked as unreliable.
MARGIN = 0.02


_OTHER = re.compile(r"[\W\d_]+")


def plain(text: str) -> bytes:
    """Lower-case letters with one space for all between them: what tells languages apart."""
    return _OTHER.sub(" ", text.lower()).encode()


def learnt_from() -> Column:
    """Documents that may be learnt from: crc32(doc_id as text) mod 5 isn't 0, lang and text aren't null."""
    return (F.crc32(F.col("doc_id").cast("string")) % 5 != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull()


def dictionaries(docs: DataFrame, docs_each: int = DOCS, chars: int = CHARS) -> dict[str, bytes]:
    """A raw-content dictionary for each language, of text from `docs_each` documents at most. The language of most documents comes first.

    Each language's documents are dealt over docs_each hash groups and the one with the least hash of
    each group is taken, so that nothing depends on the table's order and no language's rows meet in
    one task. The sample's size doesn't grow with the table.
    """
    rows = docs.filter(learnt_from())
    hashed = F.xxhash64(F.lit("langid"), F.col("doc_id"), F.col("text"))
    langs = [r["lang"] for r in rows.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").collect()]
    if not langs:
        return {}
    chars = max(LEAST, min(chars, ALL_CHARS // (len(langs) * docs_each)))
    rows = rows.select("lang", hashed.alias("h"), F.substring("text", 1, chars).alias("text"))
    least = rows.select("lang", "h").groupBy("lang", F.pmod("h", F.lit(docs_each)).alias("g")).agg(F.min("h").alias("h")).select("lang", "h")
    # One row of 16 bytes and a name for each group of each language.
    picked = F.broadcast(least) if len(langs) * docs_each <= 500_000 else least
    texts = rows.join(picked, ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"]).collect()
    by: dict[str, list] = {}
    for r in texts:
        by.setdefault(r["lang"], []).append((r["h"], r["text"]))
    out = {}
    for lang in langs:
        # zstandard finds what stands nearest to the end soonest.
        out[lang] = b" ".join(plain(t) for _, t in sorted(by.get(lang, ())))
    return out


def trigrams(data: bytes) -> np.ndarray:
    """How often each of GRAMS groups of byte trigrams stands in a plain text."""
    b = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(GRAMS)
    keys = ((b[:-2] << 16) | (b[1:-1] << 8) | b[2:]) * np.uint32(0x9E3779B1)
    return np.bincount(keys >> np.uint32(20), minlength=GRAMS).astype(float)


def profiles(raw: list[bytes]) -> np.ndarray:
    """Log shares of trigrams by language."""
    counts = np.array([trigrams(x) for x in raw]) + 0.5
    return np.log(counts / counts.sum(axis=1, keepdims=True))


class Coders:
    """Compressors by language, of which a worker keeps the last used."""

    def __init__(self, raw: list[bytes]):
        self.raw, self.held = raw, {}

    def size(self, j: int, parts: list[bytes]) -> int:
        import zstandard

        if j not in self.held:
            if len(self.held) >= CODERS:
                del self.held[next(iter(self.held))]
            words = zstandard.ZstdCompressionDict(self.raw[j], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.held[j] = zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False)
        compress = self.held[j].compress
        return sum(len(compress(x)) for x in parts)


def _score(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language, its softmax share and its relative gain over the second, from compressed bits by language."""
    best = sizes.argmin(axis=1)
    low = sizes[np.arange(len(sizes)), best]
    second = np.partition(sizes, 1, axis=1)[:, 1] if sizes.shape[1] > 1 else low * 2
    gain = (second - low) / np.maximum(second, 1)
    share = 1 / np.exp(-np.minimum((sizes - low[:, None]) / np.maximum(low[:, None], 1) * 40, 700)).sum(axis=1)
    return best, share, gain


def identify(docs: DataFrame, learn: DataFrame | None = None, margin: float = MARGIN, short: int | None = None) -> DataFrame:
    """The language of every whole text.

    docs: doc_id, text. learn: doc_id, text, lang (docs by default). Returns doc_id, held_out, lang_pred,
    score (0 to 1), gain and reliable. The text is compressed in steps with the dictionary of every learnt language, or, if
    asked for, of the `short` ones alone whose trigrams are nearest to its own, and the smallest total wins, ties to the language of more documents; every value of lang that is learnt from can be predicted; a gain under `margin` is rejected in `reliable`. lang_pred
    is und, with score 0, where text is null or has no letter, or nothing could be learnt. A null doc_id
    counts as not held out. No row moves.
    """
    importable(docs.sparkSession)
    learn = docs if learn is None else learn
    known = dictionaries(learn.select("doc_id", "text", "lang"))
    names, raw = list(known), [known[k] for k in known]
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))

    def run(frames):
        import pandas as pd
        from candela.llm import langid, tokens

        coders, many = langid.Coders(raw), bool(short) and len(raw) > short
        table = langid.profiles(raw).T if many else None
        for pdf in (part for frame in frames for part in tokens.slices(frame)):
            sizes = np.full((len(pdf), max(len(raw), 1)), np.inf if many else 0.0)
            rows = []
            for i, (text, ok) in enumerate(zip(pdf["text"], pdf["letters"], strict=True)):
                if ok and raw:
                    data = langid.plain(text)
                    tried = set(np.argsort(-(langid.trigrams(data) @ table), kind="stable")[:short].tolist()) if many else None
                    rows.append((i, [data[k : k + langid.STEP] for k in range(0, len(data), langid.STEP)], tried))
                else:
                    sizes[i] = 0
            # A language at a time, so that a coder is made once for a slice, however many there are.
            for j in range(len(raw)):
                for i, parts, tried in rows:
                    if tried is None or j in tried:
                        sizes[i, j] = coders.size(j, parts)
            best, share, gain = langid._score(sizes)
            ok = pdf["letters"].to_numpy(dtype=bool) & bool(raw)
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"].astype("Int64"),
                "held_out": pdf["held_out"],
                "lang_pred": np.where(ok, np.array(names or ["und"], dtype=object)[best], "und"),
                "score": np.where(ok, share, 0.0),
                "gain": np.where(ok, gain, 0.0),
                "reliable": ok & (gain >= margin),
            })

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    rows = docs.select("doc_id", "text", held.alias("held_out"), letters.alias("letters"))
    return rows.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double, gain double, reliable boolean")
