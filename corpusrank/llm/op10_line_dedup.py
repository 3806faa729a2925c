"""Fuzzy line dedup: SimHash blocks, edit similarity, groups.

A text is split at newlines.  Lines with a word are normalised (lower case, every run
of characters that are no letters or digits becomes one blank; a line of symbols alone
keeps them) and identified by the 64-bit hash of that form.  Equal lines of any length
fold into one entry with its first occurrence, the smallest (id, line number).

Lines of ``MIN_WORDS`` words or ``MIN_CHARS`` characters are also linked fuzzily.  A
line's features are its distinct words (from ``WORDS_FROM`` words on) and its distinct
3-character windows (below ``GRAMS_BELOW`` words, or with more than ``WORD_CHARS``
characters a word); a line between the two has both.  Blocks: the features are dealt
into classes by their hash (8 of words, 12 of windows), and every class gets its own
SimHash, the bitwise majority over the 56-bit hashes of its features.  A replaced word
changes at most two word classes, so lines that differ in up to three words still
agree in one (pigeonhole); lines that agree in a class's SimHash are candidates.
A class that a few frequent words could fill tells too little alone (two words of
together 8 characters are asked for, 12 in lines of 20 words, 16 in lines of 32, or
four windows): its key takes in the classes that follow, round from the last to the
first, until they tell enough together.  So every class with a feature gives a key, and
no line is without one.  Votes add up in packed
lanes, 7 of 8 bits in each of 8 longs; classes of more than 255 features meet by the
votes themselves.

Candidates whose lengths no edit distance can bridge go; of keys that still hold
several groups after a first round, pairs beyond ``FAR`` bits between the SimHashes of
the whole lines go too.  The rest is verified by edit similarity, ``1 - levenshtein /
longer length >= similarity``, group by group (see linking), so groups are never
expanded into all pairs; where the members of a key are compared in full, the join
itself holds lines of up to ``LONG_LINE`` characters to it.  A distance costs length times length, so of lines beyond
``LONG_LINE`` characters two bounds are tried first: pieces of ``PIECE`` characters, cut
where the other line has the same ``PROBE`` characters, whose distances add up to no less
than the lines' own, and the characters and windows that only one line has.  What they
leave open is measured in full.  Every connected group keeps its first occurrence; all other occurrences
of its lines are removed.

Null text has no lines.  Rows with a null id are left as they are.  Repeated
rows of an id are one document; all its rows get the same remaining text.  An
empty table gives no rows; extra columns are ignored, or kept by ``apply``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from corpusrank.llm.common import SPACE, WORD, alone, compacted, saved, sized, text_or_empty
from corpusrank.llm.linking import link

SIMILARITY = 0.75
LANE_WORDS, FAR = 4095, 22
CLASSES, GRAM_CLASSES, LEAST_WORDS, LEAST_GRAMS, GRAM_MARK = 8, 12, 2, 4, 63
GRAM, WORDS_FROM, GRAMS_BELOW, WORD_CHARS = 3, 6, 12, 16
MIN_WORDS, MIN_CHARS, LONG_LINE = 3, 20, 4096
PIECE, PROBE = 1024, 32


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, no, line)``: every line, numbered from 0."""
    return docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_or_empty(text_col), "\n")).alias("no", "line"))


def normalise(line: Column) -> Column:
    folded = F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))
    # nullif() evaluates its first argument once
    return F.coalesce(F.nullif(folded, F.lit("")), F.trim(F.regexp_replace(line, SPACE, " ")))


def with_simhash(rows: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """SimHash of the distinct words of ``text_col`` for every value of ``keys``."""
    part = F.expr(f"transform(sequence(0, size(_w) - 1, {LANE_WORDS}), i -> struct(i AS part, slice(_w, i + 1, {LANE_WORDS}) AS ws))")
    short = F.expr("array(struct(0 AS part, _w AS ws))")
    x = rows.select(*keys, F.array_distinct(F.transform(F.split(text_col, " "), lambda w: F.xxhash64(w))).alias("_w"))
    x = x.select(*keys, F.explode(F.when(F.size("_w") <= LANE_WORDS, short).otherwise(part)).alias("p"))
    x = x.select(*keys, F.col("p.part").alias("part"), F.explode("p.ws").alias("h"))
    spread = int("0001000100010001", 16)
    lanes = int("0008000400020001", 16)
    nibble = lambda j: F.shiftrightunsigned("h", 4 * j).bitwiseAND(F.lit(15)) * F.lit(spread)
    votes = saved(x.groupBy(*keys, "part").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(nibble(j).bitwiseAND(F.lit(lanes))).alias(f"s{j}") for j in range(16)]), "votes")
    # a lane's bit i adds 1 << i a vote
    count = lambda j, i: F.shiftrightunsigned(f"s{j}", 16 * i).bitwiseAND(F.lit(0xFFFF))
    whole = votes.where(f"n < {LANE_WORDS} AND part = 0")
    pairs = [(j, i) for j in range(16) for i in range(4)]
    set_bit = lambda c, k: F.when(c, F.lit(_bit(k))).otherwise(F.lit(0))
    one = whole.select(*keys, _or([set_bit(2 * count(j, i) > F.col("n") * (1 << i), 4 * j + i) for j, i in pairs]).alias("simhash"))
    many = (votes.where(f"n >= {LANE_WORDS} OR part > 0").groupBy(*keys)
            .agg(F.sum("n").alias("n"), *[F.sum(count(j, i)).alias(f"c{j}_{i}") for j, i in pairs]))
    many = many.select(*keys, _or([set_bit(2 * F.col(f"c{j}_{i}") > F.col("n") * (1 << i), 4 * j + i) for j, i in pairs]).alias("simhash"))
    return one.unionByName(many)


def _bit(k: int) -> int:
    return (1 << k) if k < 63 else -(1 << 63)


def _or(cols: list[Column]) -> Column:
    while len(cols) > 1:
        cols = [cols[i].bitwiseOR(cols[i + 1]) if i + 1 < len(cols) else cols[i] for i in range(0, len(cols), 2)]
    return cols[0]


def _grams(chars: Column) -> Column:
    """Distinct hashes of the windows of an array of characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size(chars) - GRAM, F.lit(0))),
                                        lambda i: F.xxhash64(*[F.get(chars, i + k) for k in range(GRAM)])))


def _marked(h: Column, mark: Column) -> Column:
    """A feature: a hash whose lowest 6 bits hold a word's characters, or ``GRAM_MARK``."""
    return h.bitwiseAND(F.lit(~63)).bitwiseOR(mark.cast("long"))


def block_keys(rows: DataFrame) -> DataFrame:
    """``(key, id)`` of the blocks of lines ``rows(line_hash, norm)``; a line may stand
    in many rows.  Equal lines meet by their hash once, and their features stay there."""
    unique = rows.groupBy("line_hash").agg(F.first("norm").alias("norm"))
    n_words = F.size(F.split("norm", " "))
    x = unique.select("line_hash", "norm", n_words.alias("n_words"),
                      F.when((n_words < GRAMS_BELOW) | (F.length("norm") > WORD_CHARS * n_words), F.split("norm", "")).alias("_c"))
    none = F.array().cast("array<bigint>")
    words = F.array_distinct(F.transform(F.split("norm", " "), lambda w: _marked(F.xxhash64(w), F.least(F.length(w), F.lit(GRAM_MARK - 1)))))
    grams = F.transform(_grams(F.col("_c")), lambda h: _marked(h, F.lit(GRAM_MARK)))
    features = F.concat(F.when(F.col("n_words") >= WORDS_FROM, words).otherwise(none), F.when(F.col("_c").isNotNull(), grams).otherwise(none))
    x = x.select("line_hash", "n_words", F.explode(features).alias("h"))
    gram = F.col("h").bitwiseAND(F.lit(63)) == GRAM_MARK
    cls = F.when(gram, F.pmod(F.shiftrightunsigned("h", 6), F.lit(GRAM_CLASSES)) + CLASSES).otherwise(F.pmod(F.shiftrightunsigned("h", 6), F.lit(CLASSES)))
    lanes = int("01010101010101", 16)                  # 7 lanes of 8 bits, in each of 8 sums
    votes = [F.sum(F.shiftrightunsigned("h", 8 + j).bitwiseAND(F.lit(lanes))).alias(f"v{j}") for j in range(8)]
    x = (x.withColumn("cls", cls.cast("int")).groupBy("line_hash", "cls")
         .agg(F.count(F.lit(1)).alias("n"), F.first("n_words").alias("n_words"), F.sum(F.col("h").bitwiseAND(F.lit(63))).alias("chars"), *votes))
    half = F.lit(lanes) * (F.lit(127) - F.expr("n DIV 2"))
    simhash = _or([F.shiftleft(F.shiftrightunsigned(F.col(f"v{j}") + half, 7).bitwiseAND(F.lit(lanes)), j) for j in range(8)])
    key = F.when(F.col("n") < 256, F.xxhash64("cls", simhash)).otherwise(F.xxhash64("cls", *[f"v{j}" for j in range(8)]))
    least = F.when(F.col("n_words") < 20, 8).when(F.col("n_words") < 32, 12).otherwise(16)
    gram = F.col("cls") >= CLASSES
    x = x.groupBy("line_hash", gram.alias("gram")).agg(
        F.first(F.when(F.col("cls") >= CLASSES, F.lit(LEAST_GRAMS)).otherwise(F.lit(LEAST_WORDS))).alias("least_n"),
        F.first(F.when(F.col("cls") >= CLASSES, F.lit(0)).otherwise(least)).alias("least_chars"),
        F.sort_array(F.collect_list(F.struct("cls", F.col("n").cast("long").alias("n"), F.col("chars").cast("long").alias("chars"), key.alias("key")))).alias("c"))
    tells = "{0}.n >= least_n AND {0}.chars >= least_chars"
    # round the classes from the i-th on, up to the first place where they tell enough
    more = f"""aggregate(concat(slice(c, i + 2, size(c)), slice(c, 1, i)), struct(c[i].n AS n, c[i].chars AS chars, c[i].key AS key),
        (s, e) -> if({tells.format('s')}, s, struct(s.n + e.n AS n, s.chars + e.chars AS chars, xxhash64(s.key, e.key) AS key)), s -> s.key)"""
    keys = F.expr(f"transform(sequence(0, size(c) - 1), i -> if({tells.format('c[i]')}, c[i].key, {more}))")
    return x.select(F.explode(keys).alias("key"), F.col("line_hash").alias("id"))


def most_edits(x: str, y: str, similarity: float) -> Column:
    return F.floor((1 - similarity) * F.greatest(F.length(x), F.length(y)) + 1e-9).cast("int")


def edits_within(x: str, y: str, most: Column) -> Column:
    """Small distances are tried first, as the banded distance costs length times bound."""
    near = lambda k: F.call_function("levenshtein", F.col(x), F.col(y), F.least(F.lit(k), most)) >= 0
    return near(32) | ((most > 32) & near(256)) | ((most > 256) & near(2**31 - 1))


def near_enough(x: str, y: str, similarity: float) -> Column:
    """Edit similarity of two columns against a floor; null where one is."""
    most = most_edits(x, y, similarity)
    return F.when(F.abs(F.length(x) - F.length(y)) > most, F.lit(False)).otherwise(edits_within(x, y, most))


def spoilt(pairs: DataFrame) -> DataFrame:
    """``(a, b)`` of those ``pairs(a, b, _x, _y, _most)`` that are too far apart: an edit
    spoils at most one character and ``GRAM`` windows of a line."""
    def side(c, sign):
        t = pairs.select("a", "b", "_most", F.split(c, "").alias("t"))
        window = lambda k: "concat(" + ", ".join(f"t[i + {j}]" for j in range(k)) + ")"
        windows = lambda k: F.expr(f"transform(sequence(0, size(t) - {k}), i -> struct({k} AS k, {window(k)} AS w))")
        return t.select("a", "b", "_most", F.explode(F.concat(windows(1), windows(GRAM))).alias("w")).select("a", "b", "_most", "w.*", F.lit(sign).alias("s"))

    over = side("_x", 1).unionByName(side("_y", -1)).groupBy("a", "b", "_most", "k", "w").agg(F.sum("s").alias("s"))
    lacks = over.groupBy("a", "b", "_most", "k").agg(F.sum(F.greatest("s", F.lit(0))).alias("x"), F.sum(F.greatest(-F.col("s"), F.lit(0))).alias("y"))
    return lacks.where(F.greatest("x", "y") > F.col("k") * F.col("_most")).select("a", "b").distinct()


def near_pieces(pairs: DataFrame) -> DataFrame:
    """``(a, b)`` of those ``pairs(a, b, _x, _y, _most)`` whose pieces, cut where ``_y``
    has the next characters of ``_x`` too, add up to at most ``_most`` edits."""
    cuts = F.expr(f"""filter(transform(sequence(0, (length(_x) - 1) DIV {PIECE}), i -> struct(int(i * {PIECE}) AS p,
        locate(substring(_x, i * {PIECE} + 1, {PROBE}), _y, greatest(i * {PIECE} - _most, 0) + 1) - 1 AS q)), c -> c.p > 0 AND c.q > 0 AND c.q - c.p <= _most)""")
    rising = F.expr("""concat(aggregate(c, array(struct(0 AS p, 0 AS q)), (s, e) -> if(e.q > element_at(s, -1).q, concat(s, array(e)), s)),
        array(struct(length(_x) AS p, length(_y) AS q)))""")
    x = compacted(pairs.select("a", "b", "_x", "_y", "_most", cuts.alias("c")).withColumn("c", rising), "line-cuts")
    piece = F.expr("""explode(transform(sequence(0, size(c) - 2), i -> struct(substring(_x, c[i].p + 1, c[i + 1].p - c[i].p) AS s,
        substring(_y, c[i].q + 1, c[i + 1].q - c[i].q) AS t)))""")
    # by number, so that the pieces of a few pairs are not measured one after the other
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = x.repartition(tasks, "a", "b").select("a", "b", "_most", piece.alias("e")).select("a", "b", "_most", "e.*")
    edits = F.when(F.greatest(F.length("s"), F.length("t")) <= LONG_LINE, F.coalesce(F.expr("nullif(levenshtein(s, t, 32), -1)"), F.levenshtein("s", "t")))
    return (x.groupBy("a", "b", "_most").agg(F.sum(edits).alias("n"), F.max(edits.isNull()).alias("open"))
            .where("NOT open AND n <= _most").select("a", "b"))


def within(x: str, y: str, most: int) -> bool:
    """Edit distance of at most ``most``, by Myers' bit vectors in Hyyroe's form: one
    step a character of ``y``, over integers with a bit a character of ``x``."""
    m, left, bits = len(x), len(y), {}
    for i, c in enumerate(x):
        bits.setdefault(c, bytearray(m // 8 + 1))[i >> 3] |= 1 << (i & 7)
    bits = {c: int.from_bytes(b, "little") for c, b in bits.items()}
    mask = (1 << m) - 1
    up, down, score = mask, 0, m
    for c in y:
        same = bits.get(c, 0)
        flat = (((same & up) + up) ^ up) | same
        more, less = down | (((flat | up) & mask) ^ mask), up & flat
        score += (more.bit_length() == m) - (less.bit_length() == m)
        left -= 1
        if score - left > most:
            return False
        more, less, level = ((more << 1) | 1) & mask, (less << 1) & mask, same | down
        up, down = less | ((level | more) ^ mask), more & level
    return score <= most


def similar_long(pairs: DataFrame) -> DataFrame:
    """``(a, b)`` of the ``pairs(a, b, _x, _y, _most)`` of long lines at most ``_most`` edits
    apart.  Few need the distance itself: bounds from below and above settle the others."""
    pairs = compacted(pairs.where(F.abs(F.length("_x") - F.length("_y")) <= F.col("_most")), "long-pairs")
    if pairs.isEmpty():
        return pairs.select("a", "b")
    near = compacted(near_pieces(pairs), "long-near")
    rest = pairs.join(near, ["a", "b"], "left_anti")
    rest = compacted(rest.join(spoilt(rest), ["a", "b"], "left_anti"), "long-rest")
    if rest.isEmpty():
        return near
    # levenshtein() takes minutes for 140,000 characters; by number, so that small partitions stay apart
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return near.unionByName(rest.repartition(tasks, "a", "b").where(F.udf(within, BooleanType(), useArrow=False)("_x", "_y", "_most")).select("a", "b"))


def line_texts(hashed: DataFrame, ids: DataFrame) -> DataFrame:
    """``(line_hash, norm)`` of ``ids(line_hash)``."""
    return compacted(hashed.select("line_hash", "norm").join(sized(ids), "line_hash", "left_semi")
                 .groupBy("line_hash").agg(F.first("norm").alias("norm")), "line-texts")


def verifier(hashed: DataFrame, similarity: float):
    """Pairs of line hashes whose normalised lines are similar."""
    holds, most = near_enough("_x", "_y", similarity), most_edits("_x", "_y", similarity)

    def verify(pairs: DataFrame) -> DataFrame:
        if pairs.isEmpty():
            return pairs
        ids = compacted(pairs.select(F.col("a").alias("line_hash")).union(pairs.select("b")).distinct(), "line-ids")
        texts = line_texts(hashed, ids)
        x = pairs.join(texts.select(F.col("line_hash").alias("a"), F.col("norm").alias("_x")), "a")
        x = x.join(texts.select(F.col("line_hash").alias("b"), F.col("norm").alias("_y")), "b")
        is_long = F.greatest(F.length("_x"), F.length("_y")) > LONG_LINE
        x = x.withColumn("_most", most)
        short = x.where(~is_long).where(holds).select("a", "b")
        if texts.where(F.length("norm") > LONG_LINE).isEmpty():
            return short
        return short.unionByName(similar_long(x.where(is_long)))

    return verify


def removed_lines(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, no, line_hash)`` of every line that another occurrence of its
    group stands for."""
    every = (lines(docs, id_col, text_col).where(F.col("id").isNotNull() & F.col("line").rlike(WORD))
             .select("id", "no", normalise(F.col("line")).alias("norm")))
    hashed = saved(every.select("id", "no", F.xxhash64("norm").alias("line_hash"), "norm"), "lines", "zstd")
    fuzzy = (F.size(F.split("norm", " ")) >= MIN_WORDS) | (F.length("norm") >= MIN_CHARS)
    keyed = saved(block_keys(hashed.where(fuzzy).select("line_hash", "norm")), "line-keys")
    entries = saved(hashed.groupBy("line_hash").agg(
        F.min(F.struct("id", "no")).alias("first"), F.count(F.lit(1)).alias("n"), F.min(F.length("norm")).alias("n_chars")), "entries")
    items = entries.select(F.col("line_hash").alias("id"), "n_chars")

    def compatible(x, y):
        longer = F.greatest(f"{x}n_chars", f"{y}n_chars")
        return longer - F.least(f"{x}n_chars", f"{y}n_chars") <= (1 - similarity) * longer + 1e-9

    def refine(ids):
        texts = line_texts(hashed, ids.select(F.col("id").alias("line_hash"))).withColumnRenamed("line_hash", "id")
        t = texts.select("id", "norm", (F.size(F.split("norm", " ")) >= GRAMS_BELOW).alias("by_words"), F.split("norm", "").alias("_c"))
        gram = F.transform(F.sequence(F.lit(0), F.greatest(F.size("_c") - GRAM, F.lit(0))),
                           lambda i: F.translate(F.array_join(F.slice("_c", i + 1, GRAM), ""), " ", "_"))
        t = t.select("id", "by_words", F.when(F.col("by_words"), F.col("norm")).otherwise(F.array_join(gram, " ")).alias("_f"))
        return with_simhash(t, ["id", "by_words"], "_f").join(texts.withColumn("norm", F.when(F.length("norm") <= LONG_LINE, F.col("norm"))), "id")

    def bound(x, y):
        near = F.bit_count(F.col(f"{x}simhash").bitwiseXOR(F.col(f"{y}simhash"))) <= FAR
        return near | (F.col(f"{x}by_words") != F.col(f"{y}by_words"))

    def last(x, y):
        return F.coalesce(near_enough(f"{x}norm", f"{y}norm", similarity), F.lit(True))

    comp, _ = link(keyed, items, ["n_chars"], compatible, verifier(hashed, similarity), refine, ["by_words", "simhash"], bound,
                   last=last, last_attrs=["norm"])
    comp = comp.withColumnRenamed("id", "line_hash")
    keep = entries.join(comp, "line_hash").groupBy("component").agg(F.min("first").alias("keep"))
    shared = (entries.join(comp, "line_hash", "left").join(keep, "component", "left")
              .withColumn("keep", F.coalesce("keep", "first")).where("n > 1 OR first <> keep").select("line_hash", "keep"))
    return (hashed.select("id", "no", "line_hash").join(shared, "line_hash")
            .where("struct(id, no) <> keep").select("id", "no", "line_hash"))


def per_document(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``(id, n_lines, n_removed, removed)``, one row per document; ``removed``
    lists the numbers of the removed lines."""
    gone = alone(lambda: removed_lines(docs, id_col=id_col, text_col=text_col, **options)
                 .groupBy("id").agg(F.array_sort(F.collect_set("no")).alias("removed")), "gone")
    n = docs.select(F.col(id_col).alias("id"), F.size(F.split(text_or_empty(text_col), "\n")).cast("long").alias("n_lines"))
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return n.join(gone, "id", "left").select(F.col("id").alias(id_col), "n_lines",
                                             F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def apply(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the removed lines.  A document that loses every line with
    a word is dropped; one without words to begin with stays."""
    gone = alone(lambda: removed_lines(docs, id_col=id_col, text_col=text_col, **options)
                 .groupBy("id").agg(F.collect_set("no").alias("gone")), "gone")
    d = docs.select(F.struct(*docs.columns).alias("d"))       # extra columns can't clash with ours
    x = d.join(gone, F.col(f"d.{id_col}") == F.col("id"), "left")
    ls = F.split(F.col(f"d.{text_col}"), "\n")
    left = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("gone")),
                                    lambda i: F.get(ls, i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col(f"d.{text_col}")).otherwise(left)
    return (x.withColumn("d", F.col("d").withField(text_col, text))
            .where(F.col("gone").isNull() | F.col(f"d.{text_col}").rlike(WORD)).select("d.*"))
