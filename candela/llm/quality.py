"""Quality rules: base counts, and distribution divergence from what a language's documents are like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from candela.llm.common import BLANK, fixed, let, whole, written

CLASSES = ("blank", "lower", "upper", "digit", "letter", "other")
#: How many of a language's words of most documents make its histogram of words.
COMMON = 24
#: What is taken off words before they are compared with common ones.
MARKS = r"[.,;:!?\"()]+"
#: Distances (0 to 1) beyond which a document is unlike its language: beyond 0.18 (characters) and 0.29 (words) lies one in a thousand of the documents of sf0.1 with few symbols and no label of bad quality.
FAR_CHARS, FAR_WORDS = 0.25, 0.29
#: Characters and words below which a histogram says too little to judge by.
LEAST_CHARS, LEAST_WORDS = 400, 80
#: Documents that a language needs to be judged by itself; rarer ones and null are judged together, as POOL.
LEAST_DOCS, POOL = 20, ""
#: Languages whose words and histograms are broadcast (about 1 kB each); more are joined, with each language's documents dealt over SALTS.
FEW_LANGS, SALTS = 20_000, 64


def _repeats(w: Column, n: Column) -> Column:
    """Words in three-word windows that occur twice or more.

    A window's hash and its place share one long, so that a sort of plain longs brings
    equal windows together; all bits that the place doesn't need are the hash's.
    """
    place = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n))) - 1
    size3 = F.lit(3).cast("long")

    def count(mask: Column, hashes: Column) -> Column:
        keyed = F.transform(hashes, lambda h, i: h.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long")))
        high = lambda x: x.bitwiseAND(F.bitwise_not(mask))
        same = lambda x, y: F.coalesce(high(x) == high(y), F.lit(False))
        twice = lambda s: F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, F.get(s, i + 1)) | same(x, F.when(i > 0, F.get(s, i - 1)))), lambda x: x.bitwiseAND(mask)))
        gaps = lambda p: F.transform(p, lambda x, i: F.least(size3, F.coalesce(F.get(p, i + 1) - x, size3)))
        return let(let(let(F.sort_array(keyed), twice), gaps), lambda g: F.aggregate(g, F.lit(0).cast("long"), lambda a, b: a + b))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))

    # Most texts have no window twice, which a set of their hashes tells.
    some = lambda x: F.when(F.size(F.array_distinct(x)) == F.size(x), F.lit(0).cast("long")).otherwise(let(place, lambda mask: count(mask, x)))
    hashes = F.transform(w, lambda x: F.xxhash64(x))
    return F.when(n < 3, F.lit(0).cast("long")).otherwise(let(let(hashes, windows), some))


def _common(text: Column, listed: Column) -> Column:
    """How often each listed word stands in a text, in the list's order."""
    # No word is looked up that is longer than all of them.
    words = lambda most: F.filter(F.split(F.regexp_replace(F.lower(text), MARKS, ""), BLANK), lambda x: F.octet_length(x) <= most)
    longest = F.coalesce(F.array_max(F.transform(listed, lambda x: F.octet_length(x))), F.lit(0))
    found = F.sort_array(F.filter(F.transform(let(longest, words), lambda x: F.array_position(listed, x)), lambda x: x > 0))
    ends = lambda s: F.filter(F.transform(s, lambda x, i: F.when(F.coalesce(F.get(s, i + 1) != x, F.lit(True)), F.struct(x.alias("word"), (i + 1).alias("end")))), lambda x: x.isNotNull())
    counts = lambda e: F.transform(e, lambda x, i: F.struct(x["word"].alias("word"), (x["end"] - F.coalesce(F.when(i > 0, F.get(e, i - 1)["end"]), F.lit(0))).alias("n")))
    one = lambda c, b: F.coalesce(F.get(F.filter(c, lambda x: x["word"] == b), F.lit(0))["n"], F.lit(0)).cast("long")
    return let(let(let(found, ends), counts), lambda c: F.transform(F.sequence(F.lit(1).cast("long"), F.lit(COMMON).cast("long")), lambda b: one(c, b)))


def _of_words(w: Column) -> Column:
    n = F.size(w)
    return F.struct(n.cast("long").alias("n_words"), _repeats(w, n).alias("n_repeat_words"))


def _of_chars(text: Column) -> Column:
    """Counts by character class; what one pattern takes out, the next needn't look at."""

    def rest(full: Column, bare: Column, plain: Column) -> Column:
        left = lambda p: F.length(plain) - F.length(F.regexp_replace(plain, p, ""))
        blank, lower = F.length(full) - F.length(bare), F.length(bare) - F.length(plain)
        upper, digit, letter = left("[A-Z]+"), left("[0-9]+"), left(r"[\p{L}&&[^A-Z]]+")
        some = lambda u, d, l: F.array(*[x.cast("long") for x in (blank, lower, u, d, l, F.length(plain) - u - d - l)])
        classes = let(F.struct(upper.alias("u"), digit.alias("d"), letter.alias("l")), lambda x: some(x["u"], x["d"], x["l"]))
        return F.struct(F.length(bare).cast("long").alias("word_chars"), F.regexp_count(plain, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), classes.alias("classes"))

    return let(F.regexp_replace(text, BLANK, ""), lambda bare: let(F.regexp_replace(bare, "[a-z]+", ""), lambda plain: rest(text, bare, plain)))


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def by_language(t: DataFrame, table: DataFrame, languages: int) -> DataFrame:
    """t, with a column _key, beside the row of table (one for each _key) that it has, if any. No language's rows meet in one task."""
    if languages <= FEW_LANGS:
        return t.join(F.broadcast(table), "_key", "left")
    salt = F.pmod(F.xxhash64("text") if "text" in t.columns else F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return t.withColumn("_salt", salt).join(salted, ["_key", "_salt"], "left").drop("_salt")


def common_words(docs: DataFrame) -> tuple[DataFrame, int]:
    """_key (a language with LEAST_DOCS texts, or POOL) and its COMMON words of most documents, ties by code points; and how many languages.

    docs: text, lang. Every document counts, each word once a document, in lower case without MARKS; what has no letter is no word.
    Counts are summed before they move, and only each task's first COMMON of a language go on.
    """
    langs = docs.filter("text IS NOT NULL").groupBy(F.coalesce("lang", F.lit(POOL)).alias("_key")).agg(F.count("*").alias("n")).filter((F.col("n") >= LEAST_DOCS) & (F.col("_key") != POOL))
    langs = written(langs.select("_key", F.col("_key").alias("_own")), "languages")
    n = langs.count()
    t = by_language(docs.filter("text IS NOT NULL").select("text", F.coalesce("lang", F.lit(POOL)).alias("_key")), langs, n)
    words = F.array_distinct(F.split(F.regexp_replace(F.lower("text"), MARKS, ""), BLANK))
    counts = t.select(F.coalesce("_own", F.lit(POOL)).alias("_key"), F.explode(words).alias("word")).groupBy("_key", "word").agg(F.count("*").alias("n"))
    order = F.row_number().over(Window.partitionBy("_key").orderBy(F.col("n").desc(), "word"))
    first = counts.filter(F.col("word").rlike(r"\p{L}")).withColumn("i", order).filter(F.col("i") <= COMMON)
    listed = first.groupBy("_key").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]).alias("_listed"))
    return written(listed, "words"), n + 1


def measured(docs: DataFrame, words: DataFrame, languages: int) -> DataFrame:
    """docs (text, lang and what else has other names) with _key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and _hist, shares of CLASSES, then of common words and of the others.

    words, languages: as common_words() gives them. No row moves.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    t = by_language(docs.withColumn("_key", F.coalesce("lang", F.lit(POOL))), words, languages)
    pool = words.filter(F.col("_key") == POOL).select("_listed").first()
    t = t.withColumn("_pool", F.array(*map(F.lit, pool[0] if pool else ())).cast("array<string>"))
    t = t.withColumns({"_key": F.when(F.col("_listed").isNull(), F.lit(POOL)).otherwise(F.col("_key")), "_listed": F.coalesce("_listed", "_pool")}).drop("_pool")
    t = fixed(t, "_m", let(text, lambda x: F.struct(let(F.filter(F.split(x, BLANK), lambda w: w != ""), _of_words).alias("w"), _of_chars(x).alias("c"), _dup_lines(x).alias("d"), _common(x, F.col("_listed")).alias("o"))))
    chars, n = _sum(F.col("_m.c.classes"), "long"), F.col("_m.w.n_words")
    others = F.greatest(n - _sum(F.col("_m.o"), "long"), F.lit(0).cast("long"))
    hist = F.concat(_shares(F.col("_m.c.classes"), chars), _shares(F.concat("_m.o", F.array(others)), n))
    return t.select(*docs.columns, "_key", "_m.w.n_words", "_m.c.word_chars", "_m.c.n_symbols", F.col("_m.d").alias("n_dup_lines"), "_m.w.n_repeat_words", chars.alias("_chars"), hist.alias("_hist"))


def _failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _shares(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda x: x / F.greatest(total, F.lit(1)))


def _sum(a: Column, kind: str = "double") -> Column:
    return F.aggregate(a, F.lit(0).cast(kind), lambda x, y: x + y)


def _means(t: DataFrame) -> DataFrame:
    """_key and the mean of _hist, where LEAST_DOCS documents make it. One row for each task and language moves."""
    mean = F.array(*[F.avg(F.get("_hist", F.lit(i))) for i in range(len(CLASSES) + COMMON + 1)])
    return t.groupBy("_key").agg(F.count("*").alias("_n"), mean.alias("_mean")).filter(F.col("_n") >= LEAST_DOCS).drop("_n")


def references(t: DataFrame, languages: int) -> DataFrame:
    """_key and _mean: the mean histogram of a language's documents that pass the base rules and aren't far from these documents' own mean.

    t: measured(). Without the far ones a language's bad documents hardly move its reference.
    """
    good = t.filter(~_failed()).select("_key", "_hist", "_chars", "n_words")
    near = _far(by_language(good, _means(good), languages)).filter(~_odd()).select("_key", "_hist")
    return written(_means(near), "references")


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2."""

    def part(x: Column, y: Column) -> Column:
        m = (x + y) / 2
        log = lambda v: F.when(v > 0, v * F.log2(v / m)).otherwise(0.0)
        return (log(x) + log(y)) / 2

    return F.sqrt(F.greatest(F.lit(0.0), _sum(F.zip_with(p, q, part))))


def _far(t: DataFrame) -> DataFrame:
    """t (_hist, _mean) with char_distance and word_distance, 0 without a reference."""
    at = len(CLASSES)
    part = lambda a, first, n: F.slice(a, first, n)
    far = F.struct(
        _distance(part(F.col("_hist"), 1, at), part(F.col("_mean"), 1, at)).alias("c"),
        _distance(part(F.col("_hist"), at + 1, COMMON + 1), part(F.col("_mean"), at + 1, COMMON + 1)).alias("w"),
    )
    t = fixed(t, "_d", F.when(F.col("_mean").isNotNull(), far))
    return t.withColumns({"char_distance": F.coalesce("_d.c", F.lit(0.0)), "word_distance": F.coalesce("_d.w", F.lit(0.0))}).drop("_d", "_mean")


def _odd() -> Column:
    return ((F.col("_chars") >= LEAST_CHARS) & (F.col("char_distance") > FAR_CHARS)) | ((F.col("n_words") >= LEAST_WORDS) & (F.col("word_distance") > FAR_WORDS))


def judged(t: DataFrame, refs: DataFrame, languages: int) -> DataFrame:
    """t, as measured(), with char_distance, word_distance, base_failed and kept."""
    t = _far(by_language(t, refs, languages))
    return t.withColumns({"base_failed": _failed(), "kept": ~_failed() & ~_odd()}).drop("_hist", "_chars", "_key")


def _measured_once(docs: DataFrame, *kept: str) -> tuple[DataFrame, DataFrame, int]:
    """docs with their measures, written once, the references and how many languages. kept: what of docs stays beside the measures."""
    words, languages = common_words(docs.select("text", "lang"))
    t = written(measured(docs, words, languages).select(*kept, *MEASURES), "measures")
    return t, references(t, languages), languages


MEASURES = ("_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "_chars", "_hist")


def assess(docs: DataFrame) -> DataFrame:
    """Base counts and verdicts of all documents.

    docs: doc_id, text, lang. Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, char_distance and word_distance. A null text has no words and
    fails; null languages and those of few documents are judged together; without enough documents to compare with, distances are 0; rows that share
    a doc_id are judged by themselves; an empty table gives no row. Texts are read twice, for their language's words and for the measures, which are written once.
    """
    out = judged(*_measured_once(docs.select("doc_id", "text", "lang"), "doc_id"))
    # Sums in another order change a distance's last digits.
    far = [F.round(c, 6).alias(c) for c in ("char_distance", "word_distance")]
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *far)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that assess() keeps, with their columns; nulls, rare languages, repeated rows and empty tables as there.

    Rows are written with their measures once; no text is measured twice or shuffled.
    """
    return judged(*_measured_once(whole(docs, "text", "lang"), "_row")).filter("kept").select("_row.*")
