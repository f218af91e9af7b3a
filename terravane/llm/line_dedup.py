"""Line deduplication: an exact set-similarity join of lines; DataFrame functions only.

A line's tokens are its distinct five-word shingles (a shorter line is one token). Equal lines are one
class. Classes meet on the first n - ceil(0.8 n) + 1 of their tokens, in an order by the length of the first word, long words being
rare: first each with the earliest class that has the token and a few just before it, so that a token of k classes gives some k
pairs, then those that found no earlier match with all earlier ones of their tokens. Sizes, places and parities bound the
pairs, and the whole sets decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terravane.llm.common import BROADCAST, Scratch, column, fresh, if_small

#: A line's identity and, in this order, its place among all lines: the id of its row (null: the greatest number), its number in
#: the row's text, and a hash of that text.
PLACE = ("d", "at", "v")
OTHER = ("yd", "yat", "yv")
#: What says, beside a token that two lines share, whether they can be similar.
BOUNDS = ("n", "p", "a", "b", "prior")
SIZE = 5
#: Earlier classes of a token, besides the first, that each class is held against at once.
BEFORE = 3
#: Bits of a token's hash, or of a place in a line, below those of a word's length.
LOW = 53


def _words(line: Column) -> Column:
    """Lower-cased runs of other than white space."""
    low = F.lower(line)
    other = [F.contains(low, F.lit(c)) for c in "\t\x0b\x0c\r"]  # rare: most lines need no replacement
    spaced = F.when(other[0] | other[1] | other[2] | other[3], F.translate(low, "\t\x0b\x0c\r", "    ")).otherwise(low)
    return F.array_remove(F.split(spaced, " "), "")


def _tokens(words: str) -> Column:
    """Distinct shingle hashes of an array column of words; none for no words."""
    at = ", ".join(f"u[i + {k}]" for k in range(SIZE))  # the words are bound to u, which is faster
    return F.expr(
        f"CASE WHEN size({words}) >= {SIZE} THEN array_distinct(get(transform(array({words}), u -> transform(sequence(0, size(u) - {SIZE}), i -> xxhash64({at}))), 0))"
        f" WHEN size({words}) > 0 THEN array(xxhash64({words}, size({words}))) ELSE array() END"
    )


def _lines(rows: DataFrame) -> DataFrame:
    """d, at and v of each line with words; the line, and two hashes of it."""
    each = rows.select("doc_id", F.xxhash64("text").alias("v"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return each.where(F.col("line").rlike(r"[^ \t\x0b\f\r]")).select(
        F.coalesce("doc_id", F.lit(2**63 - 1)).alias("d"), "at", "v", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"),
    )


def _verified(pairs: DataFrame, sets: DataFrame, numer: int, denom: int) -> DataFrame:
    """The later ones of the pairs whose whole sets reach the similarity."""
    own = sets.select(*PLACE, "tokens")
    other = sets.select(*[F.col(a).alias(b) for a, b in zip(PLACE, OTHER, strict=True)], F.col("tokens").alias("y"))
    other = other.join(if_small(pairs.select(*OTHER).distinct(), 40), [*OTHER], "left_semi")
    overlap = F.size(F.array_intersect("tokens", "y"))
    both = if_small(pairs, 64).join(own, [*PLACE]).join(other, [*OTHER])
    return both.where(denom * overlap >= numer * (F.size("tokens") + F.size("y") - overlap)).select(*PLACE).distinct()


def _admissible(numer: int, denom: int) -> str:
    """Whether sizes (n, yn), places in the order (p, yp) and parities (a, b, ya, yb) let two sets with this token reach the similarity.

    A counter of the parities that differs stands for a token, at least, that only one of the sets has.
    """
    need = f"({numer} * (n + yn) + {numer} + {denom} - 1) div ({numer} + {denom})"
    sizes = f"{denom} * n >= {numer} * yn AND {denom} * yn >= {numer} * n AND p <= n - {need} AND yp <= yn - {need}"
    return f"{sizes} AND bit_count(a ^ ya) + bit_count(b ^ yb) <= n + yn - 2 * ({need})"


def _sizes(sets: DataFrame) -> DataFrame:
    """n tokens of each set, and of 128 counters of them whether they are odd: a and b."""
    each = sets.select(*PLACE, F.explode("tokens").alias("t"))
    bit = "shiftleft(1L, cast(t & 63 as int))"
    odd = [F.expr(f"bit_xor(CASE WHEN t & 64 {half} 0 THEN {bit} ELSE 0L END)") for half in ("=", "<>")]
    return each.groupBy(*PLACE).agg(F.count("*").cast("int").alias("n"), odd[0].alias("a"), odd[1].alias("b"))


def _keys(words: DataFrame, numer: int, denom: int) -> DataFrame:
    """words (with words, as column w) with keys: the first n - ceil(0.8 n) + 1 of the n tokens, or some more, in an order that all lines share.

    Tokens are ordered by the lengths of their first words, longest first, as long words are rare, then by a hash. So only tokens
    with the longest first words are made. n is not known: it is at most the number of places where a token can begin, less the
    repeated ones among those made. Where so many repeat that too few are left, all tokens are made.
    """
    need = lambda n: f"({n} - cast(ceil({numer} * ({n}) / {denom}) as int) + 1)"
    out = words.withColumn("n", F.expr(f"greatest(size(w) - {SIZE - 1}, 1)")).withColumn("need", F.expr(need("n")))
    # the places, longest words first: 10 bits of the length, the place in the others
    code = f"shiftleft(cast(1023 - least(octet_length(x), 1023) as bigint), {LOW}) | i"
    out = out.withColumn("ranked", F.expr(f"CASE WHEN size(w) >= {SIZE} THEN sort_array(transform(slice(w, 1, n), (x, i) -> {code})) ELSE array(0L) END"))
    # all of the lengths of the first `need`, which mostly end soon after
    far = "(need + need div 2 + 2)"
    out = out.withColumn("last", F.expr(f"get(ranked, need - 1) | {(1 << LOW) - 1}"))
    long = f"CASE WHEN get(ranked, {far}) > last THEN filter(slice(ranked, 1, {far}), c -> c <= last) ELSE filter(ranked, c -> c <= last) END"
    long = f"CASE WHEN get(ranked, need) > last THEN slice(ranked, 1, need) ELSE {long} END"
    out = out.withColumn("long", F.expr(f"CASE WHEN need < n THEN {long} ELSE ranked END"))

    def codes(places: str) -> str:
        """The places' distinct tokens in their order: the length, and 53 bits of a hash."""
        token = ", ".join(f"get(u, i + {k})" for k in range(SIZE))
        hashed = f"zip_with({places}, transform({places}, c -> cast(c & {(1 << 31) - 1} as int)), (c, i) -> (c & {1023 << LOW}) | (xxhash64({token}) & {(1 << LOW) - 1}))"
        return f"array_distinct(get(transform(array(w), u -> {hashed}), 0))"  # w is bound to u, which is faster

    single = f"array(xxhash64(w, size(w)) & {(1 << LOW) - 1})"
    out = out.withColumn("codes", F.expr(f"CASE WHEN size(w) >= {SIZE} THEN {codes('long')} ELSE {single} END"))
    bound = "(n - size(long) + size(codes))"
    few = f"size(codes) < size(long) AND size(codes) < {need(bound)}"
    sort = f"CASE WHEN {few} THEN {codes('ranked')} ELSE codes END"
    return out.withColumn("keys", F.expr(f"slice(sort_array({sort}), 1, CASE WHEN {few} THEN n ELSE {need(bound)} END)")).drop("w", "n", "need", "ranked", "last", "long", "codes")


def _places(lines: DataFrame, numer: int, denom: int) -> DataFrame:
    """d, at, v of the lines; again: an equal line has an earlier place; keys, in one row of each class, that of its first line."""
    keyed = _keys(lines.select("h1", "h2", *PLACE, _words(F.col("line")).alias("w")), numer, denom)
    same = Window.partitionBy("h1", "h2").orderBy(*PLACE)
    row = keyed.select(*PLACE, "keys", F.row_number().over(same).alias("row"), *[F.first(a).over(same).alias(b) for a, b in zip(PLACE, OTHER, strict=True)])
    return row.select(*PLACE, F.expr("NOT (d = yd AND at = yat AND v = yv)").alias("again"), F.when(F.col("row") == 1, F.col("keys")).alias("keys"))


def _sets(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The whole sets of the lines at some places: of all texts only theirs are split."""
    wanted = nodes.groupBy("d", "v").agg(F.collect_set("at").alias("ats"))
    texts = rows.select(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("d"), F.xxhash64("text").alias("v"), "text").join(if_small(wanted, 64), ["d", "v"])
    # the lines are bound to p, so they are split once, and picked by number
    picked = F.transform(F.array(F.split("text", "\n")), lambda p: F.transform("ats", lambda i: F.struct(i.alias("at"), F.get(p, i).alias("line"))))
    own = texts.select("d", "v", F.inline(F.get(picked, 0))).select(*PLACE, "line").dropDuplicates([*PLACE])
    whole = own.select(*PLACE, _words(F.col("line")).alias("w")).select(*PLACE, _tokens("w").alias("tokens"))
    return whole.select(*PLACE, "tokens")


def _matched(rows: DataFrame, places: DataFrame, scratch: Scratch, numer: int, denom: int) -> DataFrame:
    """The first places of the classes that reach the similarity with an earlier class."""
    near = _admissible(numer, denom)
    earlier = lambda: [F.col(a).alias(b) for a, b in zip((*PLACE, *BOUNDS), (*OTHER, *[f"y{a}" for a in BOUNDS]), strict=True)]
    entries = places.where("NOT again").select(F.posexplode("keys").alias("p", "key"), *PLACE, "keys").select("p", "key", *PLACE, F.expr("get(keys, p - 1)").alias("prior"))
    order = Window.partitionBy("key").orderBy(*PLACE)
    several = F.lead("d").over(order).isNotNull() | F.lag("d").over(order).isNotNull()
    met = scratch.written(entries.withColumn("several", several).where("several").drop("several"), "met")
    whole = scratch.written(_sets(rows, met.select(*PLACE).distinct()), "sets")
    sizes = scratch.written(_sizes(whole), "sizes")
    stars = scratch.written(met.join(if_small(sizes, 96), [*PLACE]), "stars")
    scratch.drop(met, sizes)

    # each entry of a token that several classes have, with the earliest of them and a few just before it
    other = F.struct(*earlier())
    before = F.array(F.first(other).over(order), *[F.lag(other, k).over(order) for k in range(1, BEFORE + 1)])
    tested = stars.withColumn("before", before).select(*PLACE, *BOUNDS, F.explode("before").alias("o")).where("o IS NOT NULL").select(*PLACE, *BOUNDS, "o.*")
    pairs = scratch.written(tested.where("NOT (d = yd AND at = yat AND v = yv)").where(near).select(*PLACE, *OTHER).distinct(), "pairs")
    matched = scratch.written(_verified(pairs, whole, numer, denom), "first")

    # those without a match so far, with all earlier ones of their tokens
    open_ = stars.join(if_small(matched, 40), [*PLACE], "left_anti")
    rest = open_.join(stars.select("key", *earlier()), "key").where("yd < d OR yd = d AND (yat < at OR yat = at AND yv < v)").where(near)
    # after an equal key of both the pair has been met at that one
    rest = rest.where("coalesce(prior <> yprior, true)").select(*PLACE, *OTHER).distinct()
    rest = scratch.written(rest.join(pairs, [*PLACE, *OTHER], "left_anti"), "rest")
    scratch.drop(stars, pairs)
    both = matched if rest.isEmpty() else scratch.written(matched.union(_verified(rest, whole, numer, denom)), "matched")
    scratch.drop(whole, rest)
    return both


def removed_lines(rows: DataFrame, scratch: Scratch, numer: int = 4, denom: int = 5) -> DataFrame:
    """rows: doc_id, text. One row per text with lines to remove: d (the id, null as the greatest number), v (xxhash64 of the text), gone (their numbers, from 0)."""
    places = scratch.written(_places(_lines(rows), numer, denom), "places")
    matched = _matched(rows, places, scratch, numer, denom)
    # every line that is not its class's first one, and the first one too where an earlier class matches
    lost = places.where("again").select(*PLACE).union(matched.select(*PLACE))
    return lost.groupBy("d", "v").agg(F.collect_set("at").alias("gone"))


def _cut(docs: DataFrame, id_col: str, text_col: str, numer: int, denom: int) -> tuple[DataFrame, str, str]:
    """docs with the text cut down to the lines that stay, and the names of two more columns: its lines, and how many of them went."""
    rows = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).cast("string").alias("text"))
    d, v, gone, yd, yv, total, removed = fresh(docs, "d", "v", "gone", "yd", "yv", "n_lines", "n_removed")
    with Scratch(docs.sparkSession, "lines") as scratch:
        found = scratch.written(removed_lines(rows.where("text IS NOT NULL"), scratch, numer, denom), "gone", keep=True)
    n, numbers = found.agg(F.count("*"), F.sum(F.size("gone"))).first()
    found = found.select(F.col("d").alias(yd), F.col("v").alias(yv), F.col("gone").alias(gone))
    if 48 * n + 8 * (numbers or 0) <= BROADCAST:
        found = F.broadcast(found)
    keyed = docs.withColumn(d, F.coalesce(column(id_col).cast("long"), F.lit(2**63 - 1))).withColumn(v, F.xxhash64(column(text_col).cast("string")))
    joined = keyed.join(found, (F.col(d) == F.col(yd)) & (F.col(v) == F.col(yv)), "left")
    parts = F.split(column(text_col), "\n")
    stay = lambda p: F.array_except(F.transform(p, lambda _, i: i), F.col(gone))
    # the lines are bound to p, so they are split once, and picked by number
    kept = F.get(F.transform(F.array(parts), lambda p: F.array_join(F.transform(stay(p), lambda i: F.get(p, i)), "\n")), 0)
    out = joined.withColumn(total, F.coalesce(F.size(parts), F.lit(0))).withColumn(removed, F.coalesce(F.size(gone), F.lit(0)))
    text = F.when(F.col(gone).isNull(), column(text_col)).otherwise(kept).alias(text_col)
    columns = [text if c == text_col else column(c) for c in docs.columns]
    return out.select(*columns, total, removed), total, removed


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", numer: int = 4, denom: int = 5) -> DataFrame:
    """doc_id, n_lines, n_removed and text (cut down to the lines that stay) of each row of docs.

    Lines are compared as lower-cased words. A line goes if an earlier line has the same words, or a similarity (Jaccard, of the
    five-word shingles) of numer / denom or more; earlier is by id (null last), then number of the line, then a hash of the text.
    The lines that stay keep their order. Lines without words stay. A null text stays null and has no lines, an empty one has one;
    repeated rows are treated alike. Other columns, however named, are not read.
    """
    rows = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).cast("string").alias("text"))
    out, total, removed = _cut(rows, "doc_id", "text", numer, denom)
    return out.select("doc_id", F.col(total).cast("long").alias("n_lines"), F.col(removed).cast("long").alias("n_removed"), "text")


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", numer: int = 4, denom: int = 5) -> DataFrame:
    """docs with the lines that dedup_lines removes taken out of the text, all columns as they are, however named.

    A row whose lines with words have all gone goes; a row that had none (null, empty, white space) stays.
    """
    out, _, removed = _cut(docs, id_col, text_col, numer, denom)
    return out.where((F.col(removed) == 0) | column(text_col).rlike(r"[^\x20\x09-\x0D]")).select(*[column(c) for c in docs.columns])
