"""Text expressions: names, labels, slugs, levels, OCR identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that identify nothing, for queries and for readings.
QUERY_STOP = "de du des la le les quai quais repere reperes voie voies track tracks platform platforms gate gates marker markers sign signe panneau hall level niveau".split()
READING_STOP = "voie voies vois vote track tracks platform platforms repere marker gate hall level".split()

#: Fixed value: the characters that stripping white space takes off.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def normalised_query(q: Column) -> Column:
    """Trimmed and lower-cased, sharp s as ss; other case foldings beyond lower case are not covered."""
    return F.replace(F.lower(F.btrim(q, F.lit(WHITE))), F.lit("ß"), F.lit("ss"))


def basename(url: Column) -> Column:
    """Last part of a URL's or a path's path, without query and fragment."""
    path = F.regexp_replace(url, r"[?#].*$", "")
    return F.element_at(F.split(path, "/"), -1)


def slug(s: Column, limit: int = 80) -> Column:
    """Lower case, other than letters and digits as single hyphens, none at the ends."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.trim(s)), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), 1, limit)


def label_list(s: Column) -> Column:
    """Comma-separated labels: trimmed, lower-cased, without empty ones and repetitions, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(s, ","), lambda x: F.lower(F.trim(x))), lambda x: x != ""))


def blank_to_null(s: Column) -> Column:
    return F.nullif(F.trim(s), F.lit(""))


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def level_text(level: Column) -> Column:
    """A level as text, cut to a whole number; null for what is no number."""
    n = F.expr("1").cast("double") * level.try_cast("double")
    return F.when(n.isNotNull() & ~F.isnan(n), F.when(n >= 0, F.floor(n)).otherwise(F.ceil(n)).cast("long").cast("string"))


def thumbnail_file(key: Column, index: Column) -> Column:
    """prefix/000042.jpg of a row number."""
    return F.concat(key, F.lit("/"), F.format_string("%06d", index.cast("long")), F.lit(".jpg"))


def thumbnail_index(path: Column) -> Column:
    return F.regexp_extract(path, r"(\d{6,})\.jpg$", 1).try_cast("long")


def thumbnail_key(file: Column, prefix: str) -> Column:
    """prefix/file; blank stays blank, null null."""
    return F.when(F.trim(file) == "", file).otherwise(F.concat(F.lit(prefix.rstrip("/") + "/"), file))


def cutout_id(keyframe: Column, index: Column, stride: int) -> Column:
    return keyframe * stride + index


def cutout_parts(cutout: Column, stride: int) -> Column:
    return F.struct(F.floor(cutout / stride).cast("long").alias("keyframe"), F.pmod(cutout, F.lit(stride)).alias("index"))


def normalised_reading(s: Column) -> Column:
    """Accents of Latin letters gone, lower case, all but letters and digits as single spaces.

    Letters of the Latin-1 and Latin Extended-A blocks are covered; other compatibility forms become spaces.
    """
    accented = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįıĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž"
    plain = "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzz"
    low = F.translate(F.lower(s), accented, plain)
    return F.trim(F.regexp_replace(low, r"[^a-z0-9]+", " "))


def _tokens(normal: Column) -> Column:
    return F.filter(F.split(normal, " "), lambda t: t != "")


def _alpha(token: Column) -> Column:
    return F.regexp_replace(token, r"[^a-z]", "")


def _digit(token: Column) -> Column:
    return F.regexp_replace(token, r"[^0-9]", "")


def _numbers(normal: Column) -> Column:
    return F.regexp_extract_all(normal, F.lit(r"(\d+)"), 1)


def _telling(token: Column, stop: list[str]) -> Column:
    return (_alpha(token) != "") & ~_alpha(token).isin(stop)


def reading_query(s: Column) -> Column:
    """struct numbers, letters, mixed: what in a query can identify a sign."""
    normal = normalised_reading(s)
    t = _tokens(normal)
    mixed = F.filter(t, lambda x: (_alpha(x) != "") & (_digit(x) != ""))
    letters = F.filter(t, lambda x: _telling(x, QUERY_STOP) & ((_digit(x) != "") | (F.length(_alpha(x)) <= 2)))
    numbers = F.concat(_numbers(normal), F.transform(mixed, _digit))
    return F.struct(F.array_distinct(numbers).alias("numbers"), F.array_distinct(F.transform(letters, _alpha)).alias("letters"), F.array_distinct(mixed).alias("mixed"))


def reading_identity(s: Column) -> Column:
    """struct tokens, numbers, letters of a reading, each once, in order."""
    normal = normalised_reading(s)
    t = _tokens(normal)
    letters = F.transform(F.filter(t, lambda x: _telling(x, READING_STOP)), _alpha)
    return F.struct(t.alias("tokens"), F.array_distinct(_numbers(normal)).alias("numbers"), F.array_distinct(letters).alias("letters"))


def reading_key(identity: Column) -> Column:
    """letters=a,b;numbers=1,2; an empty part is left out."""
    part = lambda n: F.when(F.size(identity[n]) > 0, F.concat(F.lit(f"{n}="), F.array_join(identity[n], ",")))
    return F.concat_ws(";", part("letters"), part("numbers"))


def readings_compatible(a: Column, b: Column) -> Column:
    """Neither is empty, numbers and letters don't contradict, and something is shared or at least one has numbers."""
    some = lambda s, n: F.size(s[n]) > 0
    both = lambda n: some(a, n) & some(b, n)
    empty = lambda s: ~some(s, "numbers") & ~some(s, "letters")
    clash = (both("numbers") & (a["numbers"] != b["numbers"])) | (both("letters") & (a["letters"] != b["letters"]))
    return ~empty(a) & ~empty(b) & ~clash & (both("letters") | some(a, "numbers") | some(b, "numbers"))


def _key_values(key: Column, name: str) -> Column:
    chunks = F.filter(F.split(F.coalesce(key, F.lit("")), ";"), lambda c: F.trim(F.substring_index(c, "=", 1)) == name)
    values = F.flatten(F.transform(F.filter(chunks, lambda c: F.contains(c, F.lit("="))), lambda c: F.split(F.regexp_replace(c, "^[^=]*=", ""), ",")))
    return F.array_distinct(F.filter(F.transform(values, normalised_reading), lambda v: v != ""))


def reading_score(query: Column, key: Column, tokens: Column, text: Column) -> Column:
    """How well a stored reading answers a query: 1, 0.9, 0.85, 0.8, 0.7, 0.6 or 0; numbers that contradict give 0."""
    payload = normalised_reading(F.concat_ws(" ", F.coalesce(tokens, F.lit("")), F.coalesce(text, F.lit(""))))
    words = F.array_distinct(_tokens(payload))
    key_numbers, key_letters = _key_values(key, "numbers"), _key_values(key, "letters")
    numbers = F.array_union(key_numbers, _numbers(payload))
    short = F.filter(words, lambda t: _telling(t, QUERY_STOP) & (F.length(_alpha(t)) <= 2))
    letters = F.array_union(key_letters, F.transform(short, _alpha))
    q = query
    some = lambda c: F.size(c) > 0
    none = ~(some(q["numbers"]) | some(q["letters"]) | some(q["mixed"])) | ~(some(numbers) | some(letters) | some(words))
    meets = F.arrays_overlap
    clash = some(q["numbers"]) & some(numbers) & ~meets(q["numbers"], numbers)
    in_key, anywhere, as_word = meets(q["numbers"], key_numbers), meets(q["numbers"], numbers), meets(q["numbers"], words)
    letter_key, letter_any = meets(q["letters"], key_letters), meets(q["letters"], letters)
    with_both = F.when(in_key & letter_key, 1.0).when(anywhere & letter_any, 0.9).when(in_key | anywhere, 0.85).when(as_word, 0.7).otherwise(0.0)
    return (
        F.when(none | clash, 0.0)
        .when(meets(q["mixed"], words), 1.0)
        .when(some(q["numbers"]) & some(q["letters"]), with_both)
        .when(in_key, 1.0)
        .when(anywhere | as_word, 0.8)
        .when(letter_key, 0.7)
        .when(letter_any, 0.6)
        .otherwise(0.0)
    )
