"""What search is made of: the analyser, pages of hits, vector search and its fusion with words, keyboards, typos.

Word search itself is by a kept index (wordindex). Scores are added as integers of 2**-32, so that the order of
additions doesn't matter.
"""

from __future__ import annotations

import unicodedata

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
POINTS = 2.0**32
PREFIX_WEIGHT = 0.5
PREFIX_WORDS = 64
STEM_WEIGHT = 0.75
#: Words of a question that prefix_every looks at.
EVERY_WORDS = 8

_UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]+")
# Words by the default word boundaries of Unicode (UAX #29): letters and numbers, with marks; signs between two letters, or
# between two numbers, don't part them.
_LETTER, _MARKS = r"[\p{WB=ALetter}\p{WB=Hebrew_Letter}]", r"[\p{WB=Extend}\p{WB=Format}\p{WB=ZWJ}]*"
_WORD = regex.compile(
    rf"(?:(?:{_LETTER}{_MARKS}(?:[\p{{WB=MidLetter}}\p{{WB=MidNumLet}}\p{{WB=Single_Quote}}]{_MARKS}(?={_LETTER})|(?<=\p{{WB=Hebrew_Letter}}{_MARKS})\"{_MARKS}(?=\p{{WB=Hebrew_Letter}}))?)"
    rf"|(?:\p{{WB=Numeric}}{_MARKS}(?:[\p{{WB=MidNum}}\p{{WB=MidNumLet}}\p{{WB=Single_Quote}}]{_MARKS}(?=\p{{WB=Numeric}}))?)"
    rf"|\p{{WB=ExtendNumLet}}{_MARKS}|\p{{WB=Katakana}}{_MARKS})+|[^\s\p{{P}}\p{{S}}]{_MARKS}"
)
_KEPT = regex.compile(r"[^\p{L}\p{N}\p{M}]")
_ALNUM = regex.compile(r"[\p{L}\p{N}]")


class _Plain(dict):
    """What each sign outside ASCII becomes where no combining mark stands apart."""

    def __missing__(self, code: int):
        c = chr(code)
        self[code] = out = c if code < 128 else _normal(c)
        return out


def normalised(text: str) -> str:
    """NFKC, lower case, without marks on Latin, Cyrillic and Greek letters, ё as е."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKC", text).lower()
    if _APART.search(text):
        return _normal(text)
    return text.translate(_SIGNS)


def _normal(text: str) -> str:
    out, base = [], ""
    for c in unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text).lower()):
        if unicodedata.combining(c):
            if regex.match(r"[\p{Latin}\p{Cyrillic}\p{Greek}]", base or " "):
                if not (base == "и" and c == "̆"):
                    continue
        else:
            base = c
        out.append(c)
    return unicodedata.normalize("NFC", "".join(out)).replace("ё", "е")


_APART = regex.compile(r"\p{M}")
_SIGNS = _Plain()


def words(text: str | None) -> list[str]:
    """The words of a text, of letters, numbers and marks alone; runs of scripts without spaces become overlapping pairs."""
    text = normalised(text or "")
    if text.isascii() or not _UNSPACED.search(text):
        return _plain(text)
    out, at = [], 0
    for run in _UNSPACED.finditer(text):
        out += _plain(text[at : run.start()])
        g = regex.findall(r"\X", run[0])
        out += [a + b for a, b in zip(g, g[1:])] or g
        at = run.end()
    return out + _plain(text[at:])


def _plain(text: str) -> list[str]:
    return [w if w.isalnum() else _KEPT.sub("", w) for w in _WORD.findall(text) if _ALNUM.search(w)]


def best(scored: DataFrame, limit: int = 10, offset: int = 0) -> DataFrame:
    """By score, the lower document first on ties."""
    return scored.orderBy(F.desc("score"), "doc").offset(offset).limit(limit) if offset else scored.orderBy(F.desc("score"), "doc").limit(limit)


def total(scored: DataFrame, exact: int = 10_000) -> DataFrame:
    """The number of hits, exact up to a bound, and whether there are more."""
    n = scored.select("doc").limit(exact + 1).agg(F.count("*").alias("c"))
    return n.select(F.least("c", F.lit(exact).cast("long")).alias("count"), (F.col("c") > exact).alias("at_least"))


def cosine(vectors: DataFrame, key: str, column: str, asked: list[float]) -> DataFrame:
    """(doc, similarity): double arithmetic over float vectors, one pass."""
    q = F.array(*(F.lit(float(x)) for x in asked))
    dot = F.aggregate(F.zip_with(F.col(column), q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, x: a + x)
    norm = F.sqrt(F.aggregate(column, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    size = sum(x * x for x in asked) ** 0.5
    return vectors.select(F.col(key).alias("doc"), (dot / (norm * F.lit(size))).alias("similarity"))


def fused(text: DataFrame, near: DataFrame, weight: float = 0.5, pool: int = 100) -> DataFrame:
    """The best of both halves, each scaled to 0..1 over its own pool; all equal counts as 1."""

    def scaled(df: DataFrame, score: str, out: str) -> DataFrame:
        top = df.select("doc", F.col(score).alias("s")).orderBy(F.desc("s"), "doc").limit(pool)
        ends = top.agg(F.min("s").alias("a"), F.max("s").alias("b"))
        return top.join(F.broadcast(ends)).select("doc", F.when(F.col("a") == F.col("b"), 1.0).otherwise((F.col("s") - F.col("a")) / (F.col("b") - F.col("a"))).alias(out))

    both = scaled(text, "score", "w").join(scaled(near, "similarity", "v"), "doc", "full")
    return both.select("doc", (F.coalesce("w", F.lit(0.0)) * (1 - weight) + F.coalesce("v", F.lit(0.0)) * weight).alias("score"))


def reranked(text: DataFrame, near: DataFrame, pool: int = 100) -> DataFrame:
    """The best by words in the order of similarity; documents without a vector come last, in word order."""
    top = text.select("doc", F.col("score").alias("text_score")).orderBy(F.desc("text_score"), "doc").limit(pool)
    return top.join(near, "doc", "left").select("doc", F.coalesce("similarity", F.lit(-1.0)).alias("score"), "text_score")


# --- keyboards ---------------------------------------------------------------------------------------

# The characters of each layout, key by key, alone and with shift.
LAYOUTS = {
    "en": "`1234567890-=qwertyuiop[]\\asdfghjkl;'zxcvbnm,./" + '~!@#$%^&*()_+QWERTYUIOP{}|ASDFGHJKL:"ZXCVBNM<>?',
    "ru": "ё1234567890-=йцукенгшщзхъ\\фывапролджэячсмитьбю." + 'Ё!"№;%:?*()_+ЙЦУКЕНГШЩЗХЪ/ФЫВАПРОЛДЖЭЯЧСМИТЬБЮ,',
}


def retyped(piece: str, there: str, here: str) -> str:
    """What the same keys give on another layout."""
    return piece.translate(str.maketrans(LAYOUTS[there], LAYOUTS[here]))


# --- typos -----------------------------------------------------------------------------------------


def damerau(a: str, b: str, most: int) -> int:
    """Edits between two words, a swap of neighbours being one; most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, last[j - 2] + 1)
            row.append(d)
    return row[-1] if row[-1] <= most else most + 1
