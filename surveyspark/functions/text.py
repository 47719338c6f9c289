"""Extraction of species, counts and attributes from field-log text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Species words, longer names ahead of the short names inside them.
SPECIES_WORDS = (
    "ヒメハブ",
    "ガラスヒバァ",
    "ガラスヒヴァ",
    "リュウキュウアオヘビ",
    "アカマタ",
    "ヒャン",
    "ハブ",
    "オットンガエル",
    "イシカワガエル",
    "アマミハナサキガエル",
    "カエル",
    "ヤマシギ",
    "クロウサギ",
    "ネズミ",
)
OTHER_SPECIES = "その他"
TYPE_LINES = ("捕獲", "轢死", "目撃")
SIZE_PHRASES = (("ハブ捕獲大", "大"), ("ハブ捕獲中", "中"), ("ハブ捕獲小", "小"), ("極小", "極小"))
WETNESS_WORDS = ("ソークド(水跳ね)", "ウェット", "ウエット", "湿り", "ドライ")
LATITUDE_LINE = r"^(28\.[0-9]+)\s*$"
LONGITUDE_LINE = r"^(129\.[0-9]+)\s*$"


def first_contained(text: Column, words: tuple[str, ...]) -> Column:
    """The first listed word found in the text, in list order; null when none is."""
    return F.coalesce(*[F.when(text.contains(word), F.lit(word)) for word in words])


def species(text: Column) -> Column:
    return F.coalesce(first_contained(text, SPECIES_WORDS), F.lit(OTHER_SPECIES))


def individual_count(text: Column) -> Column:
    """Number written before 匹 (half or full width digits), one when absent."""
    digits = F.regexp_extract(F.translate(text, "０１２３４５６７８９", "0123456789"), r"([0-9]+)匹", 1)
    return F.coalesce(digits.try_cast("bigint"), F.lit(1).cast("bigint"))


def strip(text: Column) -> Column:
    """Trim every Unicode blank, the ideographic space included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def lines_of(text: Column) -> Column:
    return F.transform(F.split(text, r"\r\n|\r|\n"), strip)


def whole_line_choice(lines: Column, words: tuple[str, ...]) -> Column:
    """The first listed word that fills a line of its own."""
    return F.coalesce(*[F.when(F.array_contains(lines, word), F.lit(word)) for word in words])


def event_type(lines: Column) -> Column:
    return whole_line_choice(lines, TYPE_LINES)


def size_class(text: Column) -> Column:
    return reduce(
        lambda chain, pair: chain.when(text.contains(pair[0]), pair[1]),
        SIZE_PHRASES[1:],
        F.when(text.contains(SIZE_PHRASES[0][0]), SIZE_PHRASES[0][1]),
    )


def wetness(text: Column) -> Column:
    return first_contained(text, WETNESS_WORDS)


def last_number_line(lines: Column, pattern: str) -> Column:
    """Value of the last line that is one number of the wanted form."""
    hits = F.filter(lines, lambda line: line.rlike(pattern))
    return F.when(F.size(hits) > 0, F.element_at(hits, -1).try_cast("double"))
