"""Quality rules by distribution divergence, in DataFrame functions alone.

Each document gives two histograms: its character classes, and its counts of the
common words of its language (lowered, without marks at their end) and of all other
words.  Language references are the sums of these histograms over the documents that
pass the base rule, and then, once more, over those that are near these references: so
what is judged bad has no part in them.  A document is judged by the Jensen-Shannon
distance of each histogram from its language's reference.  A histogram of too few
characters or words is not judged, and the limit of a distance allows for the chance
that fewer words leave; in an unknown language the nearest reference counts.

Each text is read once, in one task and without a shuffle; the histograms go to
the shared folder, and the references, a row for each language, are joined back.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import Workspace

#: Common words by language.
COMMON_WORDS = {
    "en": "the of and to in is that it for was on are as with be this by at from or",
    "fr": "le la les de du des et en un une que qui dans pour par sur au avec est il",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als",
    "es": "el la los las de y en que un una por con para se del al es lo su como",
}

WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
PUNCTUATION = ".,;:!?'\"()-"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = "0123456789"
MARKS = ".,;:!?"  # at the end of a word
_IN_CLASS = r".,;:!?'\"()\-"  # PUNCTUATION, as it stands in a character class
_CODES = "abcdefghijklmnopqrst"


@dataclass(frozen=True)
class QualityConfig:
    least_words: int = 50
    most_repeat_percent: int = 50
    guard_chars: int = 300  # characters below which classes aren't judged
    guard_words: int = 60  # words below which common words aren't judged
    most_char_distance: float = 0.16
    char_chance: float = 3.0  # squared distance that chance gives a text, times its words
    most_word_distance: float = 0.20
    word_chance: float = 6.0
    words: dict[str, str] = field(default_factory=lambda: dict(COMMON_WORDS))


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _shares(counts: Column) -> Column:
    """Counts as shares of their sum; null where that is zero."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.transform(counts, lambda x: x / total))


def _js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two arrays of shares; null if one is."""

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    terms = F.zip_with(p, q, lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2)
    total = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.when(total < 0, 0.0).otherwise(total))


def features(docs: DataFrame, cfg: QualityConfig = QualityConfig(), carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang, the base counts, chars (array of class counts), common (array of word counts).

    Base counts: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), *carry, text.alias("_t"))
    d = d.withColumn("_b", F.btrim("_t", F.lit(WHITE)))
    d = d.withColumn("_w", F.when(F.col("_b") != "", F.split("_b", r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>")))
    d = d.withColumn("n_words", F.size("_w").cast("long"))
    n_windows = F.greatest(F.col("n_words") - 2, F.lit(0)).cast("int")
    window = lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))
    starts = F.when(n_windows > 0, F.sequence(F.lit(0), n_windows - 1)).otherwise(F.array().cast("array<int>"))
    d = d.withColumn("_k", F.transform(starts, window))
    # Windows by hash and place: equal ones lie side by side.
    tagged = F.sort_array(F.transform("_k", lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    d = d.withColumn("_s", F.when(F.size(F.array_distinct("_k")) < F.size("_k"), tagged))
    twice = F.filter(
        "_s", lambda x, j: (F.get("_s", j - 1)["k"] == x["k"]) | F.coalesce(F.get("_s", j + 1)["k"] == x["k"], F.lit(False))
    )
    d = d.withColumn("_p", F.sort_array(F.transform(twice, lambda x: x["i"])))
    gaps = F.transform("_p", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("_p", j + 1) - p, F.lit(3))))
    covered = F.aggregate(gaps, F.lit(0), lambda a, g: a + g)
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("_l", lines)
    size = F.length("_t")
    # One pass leaves the few characters that the classes count.
    d = d.withColumn("_r", F.regexp_replace("_t", f"[^{UPPER}{DIGITS}{SYMBOLS}{_IN_CLASS}]++", ""))
    # Common words as one letter each, by their place in the language's list.
    lists = F.lit(None).cast("array<string>")
    for name, words in cfg.words.items():
        lists = F.when(F.col("lang") == name, F.array(*map(F.lit, words.split()))).otherwise(lists)
    d = d.withColumn("_list", F.coalesce(lists, F.array().cast("array<string>")))
    # Short words, lowered and without marks at their end, by their place in the list (0: not there).
    place = lambda w: F.array_position("_list", F.rtrim(F.lower(w), F.lit(MARKS))).cast("int")
    short = F.filter("_w", lambda w: F.length(w) <= 7)
    places = F.filter(F.transform(short, place), lambda p: p > 0)
    d = d.withColumn("_c", F.array_join(F.transform(places, lambda p: F.substring(F.lit(_CODES), p, F.lit(1))), ""))
    counted = [(F.length("_c") - F.length(F.replace("_c", F.lit(c), F.lit("")))).cast("long") for c in _CODES]
    dropped = lambda chars: (F.length("_r") - F.length(_without(F.col("_r"), chars))).cast("long")
    d = d.select(
        "doc_id",
        "lang",
        *carry,
        "n_words",
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        dropped(SYMBOLS).alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        size.cast("long").alias("_size"),
        dropped(UPPER).alias("_upper"),
        dropped(DIGITS).alias("_digits"),
        dropped(PUNCTUATION).alias("_punct"),
        F.array(*counted, F.col("n_words") - F.length("_c")).alias("common"),
    )
    white = F.col("_size") - F.col("word_chars")
    rest = F.col("word_chars") - F.col("n_symbols") - F.col("_upper") - F.col("_digits") - F.col("_punct")
    return d.withColumn("chars", F.array(white, "n_symbols", "_upper", "_digits", "_punct", rest)).drop(
        "_size", "_upper", "_digits", "_punct"
    )


def _base_failed(cfg: QualityConfig) -> Column:
    return (F.col("n_words") < cfg.least_words) | (100 * F.col("n_repeat_words") > cfg.most_repeat_percent * F.col("n_words"))


def references(rows: DataFrame, cfg: QualityConfig = QualityConfig()) -> DataFrame:
    """A row for each language of the word lists: ref_lang, ref_chars, ref_common (shares over the rows that pass the base rule)."""
    fit = rows.where(F.col("lang").isin(*cfg.words) & ~_base_failed(cfg))
    sums = lambda name, n: _shares(F.array(*(F.sum(F.get(name, F.lit(i))) for i in range(n))).cast("array<double>"))
    return fit.groupBy(F.col("lang").alias("ref_lang")).agg(
        sums("chars", 6).alias("ref_chars"), sums("common", len(_CODES) + 1).alias("ref_common")
    )


def _settled_references(rows: DataFrame, cfg: QualityConfig) -> DataFrame:
    """References over the rows that are near the references over all rows."""
    first = references(rows, cfg)
    return references(_measured(rows, first, cfg).where("near").select(*rows.columns), cfg)


def judge(docs: DataFrame, cfg: QualityConfig = QualityConfig()) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, char_distance and word_distance for each row.

    Defined cases: a null or empty text has no words and fails the base rule; a null
    doc_id stays null; in a null or unknown language the nearest reference of character
    classes counts and words aren't judged; a distance below its length guard is null and
    doesn't reject; a long text is one row of one task, read whole; repeated rows are returned as often as they occur; an empty table gives an empty
    result.
    """
    work = Workspace(docs.sparkSession, "quality")
    rows = work.save(features(docs, cfg), "features")
    return _verdict(rows, _settled_references(rows, cfg), cfg)


def keep_good(docs: DataFrame, cfg: QualityConfig = QualityConfig()) -> DataFrame:
    """The rows of `docs`, all columns, that the rules keep.

    The rows wait in the shared folder, beside their histograms, for the references.  Null,
    empty and long texts, unknown languages and repeated rows are judged as in `judge`; an
    empty table gives an empty result; other columns, whatever their names, stay as they are.
    """
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    whole = docs.select("doc_id", F.col("text").cast("string").alias("text"), lang.alias("lang"), F.struct("*").alias("row"))
    rows = Workspace(docs.sparkSession, "quality").save(features(whole, cfg, ("row",)), "features")
    return _verdict(rows, _settled_references(rows.drop("row"), cfg), cfg, ("row",)).where("kept").select("row.*")


def _measured(rows: DataFrame, refs: DataFrame, cfg: QualityConfig) -> DataFrame:
    """`rows` with char_distance, word_distance and near: whether neither is above its limit."""
    # One row for each language of the lists: bounded, so it may be broadcast as one row.
    refs = refs.groupBy().agg(
        F.map_from_entries(F.collect_list(F.struct("ref_lang", F.struct("ref_chars", "ref_common")))).alias("refs")
    )
    joined = rows.join(F.broadcast(refs))
    for name in ("chars", "common"):
        joined = joined.withColumn(f"_{name}", _shares(F.col(name).cast("array<double>")))
    own = F.col("refs")[F.col("lang")]
    nearest = F.array_min(F.transform(F.map_values("refs"), lambda r: _js_distance(F.col("_chars"), r["ref_chars"])))
    size = F.aggregate("chars", F.lit(0).cast("bigint"), lambda a, x: a + x)
    judged = joined.withColumn(
        "char_distance",
        F.when(size >= cfg.guard_chars, F.coalesce(_js_distance(F.col("_chars"), own["ref_chars"]), nearest)),
    ).withColumn("word_distance", F.when(F.col("n_words") >= cfg.guard_words, _js_distance(F.col("_common"), own["ref_common"])))

    def within(distance: str, most: float, chance: float) -> Column:
        return F.coalesce(F.col(distance), F.lit(0.0)) <= F.sqrt(most**2 + chance / F.greatest("n_words", F.lit(1)))

    near = within("char_distance", cfg.most_char_distance, cfg.char_chance) & within("word_distance", cfg.most_word_distance, cfg.word_chance)
    return judged.withColumn("near", near).drop("refs", "_chars", "_common")


def _verdict(rows: DataFrame, refs: DataFrame, cfg: QualityConfig, carry: tuple[str, ...] = ()) -> DataFrame:
    failed = _base_failed(cfg)
    return _measured(rows, refs, cfg).select(
        "doc_id",
        *carry,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & F.col("near")).alias("kept"),
        "char_distance",
        "word_distance",
    )
