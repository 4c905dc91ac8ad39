"""Tokenizers, trimming, hashing and set scores as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, although it occurs there often or inside a lambda."""
    return F.transform(F.array(value), use)[0]


#: Characters that compatibility composition leaves as they are, whatever stands beside them: of common scripts, not all there are.
STABLE = (
    r"\x00-\x7F\u00A1-\u00A7\u00A9\u00AB\u00AC\u00AE\u00B0\u00B1\u00B6\u00B7\u00BB\u00BF\u00C0-\u0131\u0134-\u013E\u0141-\u0148\u014A-\u017E\u0180-\u01C3"
    r"\u0391-\u03A1\u03A3-\u03CE\u0400-\u0482\u048A-\u052F\u2013\u2014\u2018-\u201A\u201C-\u201E\u20AC\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FFF\uAC00-\uD7A3"
)


def nfkc(text) -> Column:
    """The text in compatibility composition (NFKC): full-width letters are plain ones, ligatures their letters, marks part of their letters.

    Texts of STABLE characters are looked at once and stay as they are; only others go through the Unicode library that comes with Spark, within the JVM. Spark
    takes calls into libraries for ones whose result may vary, so it computes this where it stands and does not move it.
    """
    t = _col(text)
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(t, F.lit("")), F.lit(True))
    # Beyond ASCII first: the class of all STABLE characters takes Java many times longer for each letter.
    return F.when(t.rlike(rf"[\x{{80}}-\x{{10FFFF}}&&[^{STABLE}]]"), composed).otherwise(t)


def words(text) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text in compatibility composition."""
    return F.regexp_extract_all(F.lower(nfkc(text)), F.lit("[a-z0-9]+"), 0)


def stem(word: Column) -> Column:
    """A plural's singular, by the first ending that fits."""
    n = F.length(word)
    return (
        F.when((n > 4) & word.endswith("ies"), F.concat(F.substring(word, F.lit(1), n - 3), F.lit("y")))
        .when((n > 4) & word.endswith("es"), F.substring(word, F.lit(1), n - 2))
        .when((n > 3) & word.endswith("s"), F.substring(word, F.lit(1), n - 1))
        .otherwise(word)
    )


def stems(text) -> Column:
    return F.transform(words(text), stem)


def unicode_stems(text) -> Column:
    """Stems of runs of letters and digits of any script."""
    return F.transform(F.regexp_extract_all(F.lower(nfkc(text)), F.lit(r"[\p{L}\p{N}]+"), 0), stem)


def long_words(text) -> Column:
    """Words of over two word characters, repeats kept."""
    return F.filter(F.split(F.lower(_col(text)), "[^a-zA-Z0-9_]+"), lambda w: F.length(w) > 2)


def keywords(text, least: int = 3) -> Column:
    """Runs of at least so many a-z and 0-9."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(f"[a-z0-9]{{{least},}}"), 0)


#: White space at the ends; Spark's trim() takes blanks only.
BLANKS = " \t\n\r\f\u000b"


def trimmed(text) -> Column:
    return F.trim(_col(text), F.lit(BLANKS))


def collapsed(text) -> Column:
    return trimmed(F.regexp_replace(_col(text), r"\s+", " "))


def summary(text, most: int) -> Column:
    """The collapsed text, or its beginning with an ellipsis if it is longer than ``most``."""
    flat = collapsed(text)
    return F.when(F.length(flat) > most, F.concat(trimmed(F.substring(flat, 1, most - 1)), F.lit("…"))).otherwise(flat)


def trigrams(text) -> Column:
    """The distinct character trigrams of the words written without blanks; a shorter text is its own."""

    def of(flat: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.length(flat) - 2), lambda i: F.substring(flat, i, F.lit(3)))
        return F.when(F.length(flat) >= 3, F.array_distinct(grams)).when(F.length(flat) > 0, F.array(flat)).otherwise(F.array().cast("array<string>"))

    return let(F.array_join(words(text), ""), of)


def ngrams(text, n: int = 3) -> Column:
    """The distinct character n-grams of the lower-cased text without white space; a shorter text is its own."""

    def of(flat: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.length(flat) - n + 1), lambda i: F.substring(flat, i, F.lit(n)))
        return F.when(F.length(flat) >= n, F.array_distinct(grams)).when(F.length(flat) > 0, F.array(flat)).otherwise(F.array().cast("array<string>"))

    return let(F.regexp_replace(F.lower(nfkc(text)), r"\s+", ""), of)


def hash31(word: Column) -> Column:
    """The polynomial hash of base 31 in 32 unsigned bits."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("bigint"), lambda h, c: (h * 31 + F.ascii(c)) % 4294967296)


def fnv1a(word: Column) -> Column:
    """FNV-1a in 32 bits over code points."""
    step = lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("bigint")) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.aggregate(F.split(word, ""), F.lit(2166136261), step)


def set_cosine(a: Column, b: Column) -> Column:
    """Shared members over the geometric mean of the sizes of two distinct arrays; 0 if either is empty."""

    def of(x: Column) -> Column:
        n = F.size(x["a"]) * F.size(x["b"])
        return F.when(n > 0, F.size(F.array_intersect(x["a"], x["b"])) / F.sqrt(n.cast("double"))).otherwise(F.lit(0.0))

    return let(F.struct(a.alias("a"), b.alias("b")), of)


def rounded(x: Column, digits: int) -> Column:
    """Half up on the binary value, the same in every engine."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def to_fixed(x: Column, digits: int) -> Column:
    """The double's exact value rounded to ``digits`` (9 at most), of two equally near the larger by size: 1.005 gives 1.0, 8.345 gives 8.35, 1.115 gives 1.11.

    The scaled number's rounding error is found exactly by splitting both factors, so a number just below a half is not taken for one.
    Numbers whose scaled size is 2^52 and more, infinities and NaN stay as they are.
    """
    if not 0 <= digits <= 9:
        raise ValueError("digits must be from 0 to 9")
    scale, split = float(10**digits), 134217729.0  # 2^27 + 1
    high = split * scale - (split * scale - scale)
    low = scale - high

    def of(v: Column) -> Column:
        p, h = v["a"] * scale, split * v["a"] - (split * v["a"] - v["a"])
        return let(F.struct(p.alias("p"), (((h * high - p) + h * low + (v["a"] - h) * high) + (v["a"] - h) * low).alias("e")), done)

    def done(v: Column) -> Column:
        whole = F.floor(v["p"]).cast("double")
        return F.when((v["p"] - whole - 0.5) + v["e"] >= 0, whole + 1).otherwise(whole) / scale

    small = F.abs(x) * scale < 2.0**52
    return F.when(x.isNull(), x).when(~small | F.isnan(x), x).otherwise(F.signum(x) * let(F.struct(F.abs(x).alias("a")), of))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def agrees(rows, wanted: dict) -> Column:
    """Whether a row has all the values wanted; null equals null only, and a column that the rows lack fits nothing."""
    out = F.lit(True)
    for name, value in wanted.items():
        out = out & (F.col(name).eqNullSafe(F.lit(value)) if name in rows.columns else F.lit(False))
    return out


def at_least_zero(x: Column) -> Column:
    """The number, or 0 if it is null, negative or none at all."""
    return F.when(x.isNotNull() & ~F.isnan(x) & (x >= 0), x).otherwise(F.lit(0.0))


def first_issue(rules) -> Column:
    """The message of the first (condition, message) whose condition holds; null if none does."""
    return F.coalesce(*[F.when(condition, message) for condition, message in rules])


def preview(text: Column, most: int) -> Column:
    """The text, or its beginning with three dots if it is longer than ``most``."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def contains_all(text: Column, parts: Column) -> Column:
    """Whether the text has every one of the parts in it, in any case."""
    return F.forall(parts, lambda p: F.contains(F.lower(text), F.lower(p)))


def snake(name: Column) -> Column:
    """An underscore and the small letter for each capital."""
    return F.lower(F.regexp_replace(name, "([A-Z])", "_$1"))


def label_set(**labels: Column) -> Column:
    """Names and values of labels in braces, with backslashes before backslashes, quotes and line ends in values."""
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'{k}="'), escaped(v), F.lit('"')) for k, v in labels.items()]), F.lit("}"))


def exact_mean(x: Column, scale: int = 1000) -> Column:
    """The mean of numbers that are whole multiples of 1 / ``scale``, summed as integers: the same in whatever order they come."""
    return F.sum(F.round(x * scale).cast("bigint")).cast("double") / (scale * F.count(x))
