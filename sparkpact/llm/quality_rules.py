"""Quality rules: plain base counts, then the divergence of a document's histograms from its language's reference.

Three histograms are compared by Jensen-Shannon distance: character classes, the share of each common word of the language
(with one bin for all other words), and single symbols such as '|' beside the number of words. The references are the
corpus's own, of a fixed size for each language: the mean histograms of all its documents that pass the base rules. Common
words are given for a few languages (``COMMON``) and learned for every other one that the table names: those found in the
most documents. A document is rejected if a distance passes its threshold, which falls with the number of words as sampling
noise does. No distance is judged, and the base rules alone decide, for documents below ``min_words`` words and for those of
no language or a rare one (under ``min_documents`` documents, or under one in ``1 / min_share``).

Null and empty texts have no words and fail the base rule; texts of any length are counted whole; repeated rows are judged
alike; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import utf8
from .license_scan import TO_WORDS

#: Common words by language: fixed values.
COMMON = {
    "en": "the of and to a in is that it for was on are as with be by at this from or an have not but".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero".split(),
}
_KINDS = [range(0x61, 0x7B), range(0x41, 0x5B), range(0x30, 0x3A), b" \t\r\x0b\x0c", b"\n", b".,;:!?'\"()-", b"#*$%&|<>@^~`_=+/\\{}[]", range(0xC2, 0xF5)]
#: Bytes to character classes: lower, upper, digit, blank, line end, punctuation, symbol, start of a non-ASCII character, the rest.
CLASS_OF = np.full(256, len(_KINDS))
for _k, _bytes in enumerate(_KINDS):
    CLASS_OF[list(_bytes)] = _k
CLASSES = np.eye(len(_KINDS) + 1)[CLASS_OF]
CLASSES[0x80:0xC0] = 0  # the rest of a character that is counted already
SYMBOLS = list(_KINDS[6])
_CONTINUES = bytes(range(0x80, 0xC0))
_WHITE = b" \t\n\r\x0b\x0c"


def class_histogram(text: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ CLASSES


def symbol_histogram(text: bytes, words: float) -> np.ndarray:
    """The number of words and that of each symbol."""
    return np.concatenate(([words], np.bincount(np.frombuffer(text, np.uint8), minlength=256)[SYMBOLS]))


def limit(floor: float, noise: float, words: int) -> float:
    """The threshold of a distance for a text of so many words."""
    return floor + noise / np.sqrt(words)


def word_histogram(text: bytes, common: list[bytes]) -> np.ndarray:
    """The counts of a language's common words and of all others."""
    words = text.translate(TO_WORDS).split()
    n = Counter(words)
    own = [n[w] for w in common]
    return np.array([*own, len(words) - sum(own)], float)


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> float:
    """The distance (square root of the divergence in bits, 0 to 1) of two histograms; 1 if one of them is empty."""
    if not p.sum() or not q.sum():
        return 1.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = lambda a: np.where(a > 0, a * np.log2(a / m), 0).sum()
        return float(np.sqrt(max(0.0, (kl(p) + kl(q)) / 2)))


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """How many words lie in a window of ``width`` words that is found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    with np.errstate(over="ignore"):
        acc = np.zeros(n, np.uint64)
        for k in range(width):
            acc = (acc ^ (acc >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[k : k + n]
    ordered = np.sort(acc)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(np.isin(acc, twice))
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + width, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    solid = text.translate(None, _WHITE)
    seen, again = set(), 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            again += line in seen
            seen.add(line)
    return len(words), len(solid.translate(None, _CONTINUES)), len(text) - len(text.translate(None, b"#*$%&|<>")), again, repeated_words(words)


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 20 or 100 * n_repeat_words > 30 * n_words


def common_words(docs: DataFrame, min_documents: int, min_share: float, size: int = 30, least_share: float = 0.05) -> dict[str, list[bytes]]:
    """The common words of each language of the table that is not rare: at most ``1 / min_share`` languages.

    For languages without given words: the ``size`` words found in the most documents, of those found in ``least_share``.
    """
    counts = docs.groupBy("lang").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    frequent = {r["lang"]: r["n"] for r in counts.where(F.col("lang").isNotNull() & (F.col("n") >= max(min_documents, min_share * total))).collect()}
    out = {lang: [w.encode() for w in words] for lang, words in COMMON.items() if lang in frequent}
    learned = {lang: n for lang, n in frequent.items() if lang not in COMMON}
    if not learned:
        return out

    def each(batches):
        for batch in batches:
            n: Counter = Counter()
            for lang, text in zip(batch.column("lang").to_pylist(), utf8(batch.column("text")), strict=True):
                n.update((lang, w) for w in {*text.translate(TO_WORDS).split()})
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in n]), pa.array([k[1] for k in n], pa.binary()), pa.array([*n.values()], pa.int64())], names=["lang", "word", "n"])

    least = F.create_map(*(F.lit(x) for lang, n in learned.items() for x in (lang, least_share * n)))
    found = docs.where(F.col("lang").isin(*learned)).mapInArrow(each, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    # a text has few words that so many others have: what is left of a language is small
    found = found.where(F.col("n") >= least[F.col("lang")])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    for r in found.withColumn("rank", rank).where(F.col("rank") <= size).orderBy("lang", "rank").collect():
        out.setdefault(r["lang"], []).append(bytes(r["word"]))
    return out


def references(docs: DataFrame, common: dict[str, list[bytes]], min_words: int = 50) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The mean histograms of all documents of ``min_words`` words of each language that pass the base rules: a short row each.

    Every document counts alike, so a few very long ones don't set the reference.
    """
    bins = {lang: len(CLASSES[0]) + len(words) + 1 + len(SYMBOLS) + 1 for lang, words in common.items()}
    if not common:
        return {}

    def each(batches):
        total = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), utf8(batch.column("text")), strict=True):
                words = word_histogram(text, common[lang])
                own = text.split()
                if words.sum() >= min_words and not base_failed(len(own), repeated_words(own)):
                    found = class_histogram(text), words, symbol_histogram(text, words.sum())
                    total[lang] = total.get(lang, 0) + np.concatenate([h / h.sum() for h in found])
        if total:
            yield pa.RecordBatch.from_pydict({"lang": pa.array([*total]), "sums": pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))})

    parts = docs.where(F.col("lang").isin(*common)).mapInArrow(each, "lang string, sums array<double>")
    sums: dict[str, np.ndarray] = {}
    for r in parts.select("lang", F.posexplode("sums")).groupBy("lang", "pos").agg(F.sum("col").alias("n")).collect():
        sums.setdefault(r["lang"], np.zeros(bins[r["lang"]]))[r["pos"]] = r["n"]
    return {lang: tuple(np.split(v, [len(CLASSES[0]), len(v) - len(SYMBOLS) - 1])) for lang, v in sums.items()}


def judge_quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_words: int = 50, class_limit: tuple[float, float] = (0.14, 1.0), word_limit: tuple[float, float] = (0.09, 2.0), symbol_limit: tuple[float, float] = (0.25, 0.4), keep: bool = False, min_documents: int = 30, min_share: float = 1e-4) -> DataFrame:
    """The base counts, class_distance, word_distance (null if not judged), base_failed and kept of every row.

    The limits are a floor and what is added for sampling noise in a text of one word. The symbols' distance is judged too.
    keep: hand on all columns of df instead, of the rows that are kept.
    """
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    common = common_words(docs, min_documents, min_share)
    known = references(docs, common, min_words)

    def judge(text: bytes, lang: str | None) -> tuple:
        n, chars, symbols, dup, repeat = base_counts(text)
        failed = base_failed(n, repeat)
        if n < min_words or lang not in known:
            return n, chars, symbols, dup, repeat, None, None, failed, not failed
        words = word_histogram(text, common[lang])
        by_class, by_word = jensen_shannon(class_histogram(text), known[lang][0]), jensen_shannon(words, known[lang][1])
        by_symbol = jensen_shannon(symbol_histogram(text, words.sum()), known[lang][2])
        good = by_class <= limit(*class_limit, n) and by_word <= limit(*word_limit, n) and by_symbol <= limit(*symbol_limit, n)
        return n, chars, symbols, dup, repeat, by_class, by_word, failed, bool(not failed and good)

    if keep:

        def sift(batches):
            for batch in batches:
                kept = [judge(t, lang)[-1] for t, lang in zip(utf8(batch.column(text_col)), batch.column(lang_col).to_pylist(), strict=True)]
                yield batch.filter(pa.array(kept, pa.bool_()))

        return df.mapInArrow(sift, df.schema)

    def each(batches):
        kinds = [pa.int64()] * 5 + [pa.float64()] * 2 + [pa.bool_()] * 2
        for batch in batches:
            if batch.num_rows:
                rows = [judge(t, lang) for t, lang in zip(utf8(batch.column("text")), batch.column("lang").to_pylist(), strict=True)]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=[id_col, *COLUMNS])

    return docs.mapInArrow(each, f"`{id_col}` long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, class_distance double, word_distance double, base_failed boolean, kept boolean")


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "base_failed", "kept")
