"""Merkle trees over sections and paragraphs, in SQL functions only.

Blank lines part sections, line feeds paragraphs.  A paragraph's hash is the SHA-256 of
its text, a section's that of its paragraphs' hashes in order, the root that of its
sections', so equal roots mean equal texts.  The fingerprint writes the root, then eight
digits of each paragraph's hash in the tree's shape (``;`` sections, ``/`` paragraphs).

Two trees are compared from the root down.  Equal roots end the comparison; of the
sections, then of the paragraphs of what is left, those with a hash on both sides count
as shared, unopened; the leaves of the other paragraphs are compared last.  A leaf is a
word with the blanks before it (every 32 characters of a longer run are one), together
with the leaf before it in its paragraph: where leaves end follows from the text around
them, whatever the text's length, so an edit moves none but its own.  The likeness is
the share of characters, 0 to 1, in what both sides have, each different branch or leaf
counted once.

Defined cases: null text counts as empty; null doc_ids sort first, equal ones by a hash
of the text; of equal rows the first have each other as next document; a table of one
row has itself as next document; texts without a character in common are alike to 0.0,
and only equal texts to 1.0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surety.llm import shared

#: Fixed values of the rule for leaves: blanks, then the longest piece of a word; the most characters that a leaf weighs.
BLANK = r" \t\n\x0B\f\r"
LEAF, MOST_WEIGHT = rf"[{BLANK}]*+[^{BLANK}]{{1,32}}+|[{BLANK}]++", 63
#: Equal rows that one task writes at most.
SPREAD = 1_000_000
HEX, DIGITS = 64, 10


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _hash(kind: str, content: Column) -> Column:
    return F.sha2(F.concat(F.lit(kind), content), 256)


def tree(text: Column) -> Column:
    """struct(root, sections array<struct(hash, paragraphs array<hash>)>)."""
    paragraphs = F.transform(F.split(text, "\n\n", -1), lambda s: F.transform(F.split(s, "\n", -1), lambda p: _hash("p", p)))
    sections = F.transform(paragraphs, lambda p: F.struct(_hash("s", F.array_join(p, ",")).alias("hash"), p.alias("paragraphs")))
    return let(sections, lambda s: F.struct(_hash("r", F.array_join(F.transform(s, lambda x: x["hash"]), ",")).alias("root"), s.alias("sections")))


def fingerprint(of: Column) -> Column:
    """Text form of a tree."""
    shape = F.transform(of["sections"], lambda s: F.array_join(F.transform(s["paragraphs"], lambda p: F.substr(p, F.lit(1), F.lit(8))), "/"))
    return F.concat(of["root"], F.lit("|"), F.array_join(shape, ";"))


def _branch(hashed: Column, text: Column) -> Column:
    """A branch as one string: its hash, which tells branches apart, then its weight and what it opens to."""
    return F.concat(hashed, F.lpad(F.char_length(text).cast("string"), DIGITS, "0"), text)


def _inside(branch: Column) -> Column:
    return F.substr(branch, F.lit(HEX + DIGITS + 1))


def _weight(branches: Column) -> Column:
    return F.aggregate(branches, F.lit(0).cast("long"), lambda a, x: a + F.substr(x, F.lit(HEX + 1), F.lit(DIGITS)).cast("long"))


def leaves(paragraph: Column) -> Column:
    """A number for each leaf, its low six bits the leaf's weight."""
    words = F.regexp_extract_all(paragraph, F.lit(LEAF), F.lit(0))
    return let(
        words,
        lambda w: F.transform(w, lambda x, i: F.shiftleft(F.xxhash64(F.when(i > 0, F.get(w, i - 1)).otherwise(F.lit("")), F.lit(""), x), 6).bitwiseOR(F.least(F.char_length(x), F.lit(MOST_WEIGHT)).cast("long"))),
    )


def _leaf_weight(of: Column) -> Column:
    return F.aggregate(of, F.lit(0).cast("long"), lambda a, x: a + x.bitwiseAND(F.lit(MOST_WEIGHT)))


def likeness(a: Column, a_tree: Column, b: Column, b_tree: Column) -> Column:
    """Comparison of two texts by their trees, from the root down."""

    def sections(text: Column, of: Column) -> Column:
        return F.array_distinct(F.zip_with(of["sections"], F.split(text, "\n\n", -1), lambda s, t: _branch(s["hash"], t)))

    def paragraphs(opened: Column) -> Column:
        return F.array_distinct(F.flatten(F.transform(opened, lambda s: F.transform(F.split(_inside(s), "\n", -1), lambda p: _branch(_hash("p", p), p)))))

    def of_leaves(opened: Column) -> Column:
        return F.array_distinct(F.flatten(F.transform(opened, lambda p: leaves(_inside(p)))))

    def level(x: Column, y: Column, then: Callable[[Column, Column, Column], Column]) -> Column:
        """``then(weight of what both have, what x has beside it, what y has beside it)``."""
        pair = F.struct(F.array_intersect(x, y).alias("both"), F.array_except(x, y).alias("x"), F.array_except(y, x).alias("y"))
        return let(pair, lambda p: then(_weight(p["both"]), p["x"], p["y"]))

    def last(shared_weight: Column, x: Column, y: Column) -> Column:
        pair = F.struct(of_leaves(x).alias("x"), of_leaves(y).alias("y"))
        sums = let(pair, lambda p: F.struct((2 * (shared_weight + _leaf_weight(F.array_intersect(p["x"], p["y"])))).alias("shared"), (2 * shared_weight + _leaf_weight(p["x"]) + _leaf_weight(p["y"])).alias("total")))
        whole = lambda s: F.when(s["total"] == 0, 0.0).when(s["shared"] == s["total"], 1 - F.lit(1.0) / (s["total"] + 1)).otherwise(s["shared"].cast("double") / s["total"])
        return let(sums, whole)

    def below(weight: Column, x: Column, y: Column) -> Column:
        pair = F.struct(weight.alias("weight"), paragraphs(x).alias("x"), paragraphs(y).alias("y"))
        return let(pair, lambda p: level(p["x"], p["y"], lambda w, u, v: last(p["weight"] + w, u, v)))

    opened = let(F.struct(sections(a, a_tree).alias("x"), sections(b, b_tree).alias("y")), lambda p: level(p["x"], p["y"], below))
    return F.when(a_tree["root"] == b_tree["root"], 1.0).otherwise(opened)


def changed_paragraphs(a: Column, b: Column) -> Column:
    """(section, paragraph) places whose hashes differ between two trees; equal branches stay closed."""
    place = "array<struct<section:int,paragraph:int>>"

    def inside(x, y, s):
        x, y = F.coalesce(x["paragraphs"], F.array().cast("array<string>")), F.coalesce(y["paragraphs"], F.array().cast("array<string>"))
        marked = F.transform(F.zip_with(x, y, lambda p, q: ~p.eqNullSafe(q)), lambda d, i: F.when(d, F.struct(s.alias("section"), i.alias("paragraph"))))
        return F.filter(marked, lambda m: m.isNotNull()).cast(place)

    pairs = F.zip_with(a["sections"], b["sections"], lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    opened = F.transform(pairs, lambda p, s: F.when(p["x"]["hash"].eqNullSafe(p["y"]["hash"]), F.array().cast(place)).otherwise(inside(p["x"], p["y"], s)))
    return F.when(a["root"] == b["root"], F.array().cast(place)).otherwise(F.flatten(opened))


KEYS = ["named", "key", "h"]


def with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, text (null: empty), next_text and copies: how many equal rows a row stands for; and the most copies of any.

    Keys alone are put in order, by range partitions and the first key of the next one;
    then each different text moves twice, once as itself and once to the row before it.
    """
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(F.col("doc_id").isNotNull().alias("named"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("key"), F.xxhash64(text).alias("h"), text.alias("text"))
    texts = docs.groupBy(*KEYS).agg(F.first("text").alias("text"))
    counted = docs.groupBy(*KEYS).agg(F.count("*").alias("m"))
    placed = shared.materialise(counted.repartitionByRange(*KEYS).withColumn("range", F.spark_partition_id()), "order")
    after = F.lead(F.struct(*KEYS)).over(Window.partitionBy("range").orderBy(*KEYS))
    heads = placed.groupBy("range").agg(F.min(F.struct(*KEYS)).alias("head"))  # one row a range
    by_range = Window.orderBy("range")
    heads = heads.select("range", F.coalesce(F.lead("head").over(by_range), F.first("head").over(by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("head"))
    pairs = placed.select(*KEYS, "m", "range", after.alias("after")).join(heads, "range").withColumn("after", F.coalesce("after", "head"))
    pairs = pairs.select(*[F.col(c).alias(f"own_{c}") for c in KEYS], "m", *[F.col("after")[c].alias(c) for c in KEYS])
    led = pairs.join(texts, KEYS).select(*[F.col(f"own_{c}").alias(c) for c in KEYS], "m", F.col("text").alias("next_text"))
    both = texts.join(led, KEYS)
    one = F.struct("next_text", F.lit(1).cast("long").alias("copies"))
    more = F.struct(F.col("text").alias("next_text"), (F.col("m") - 1).alias("copies"))
    out = both.withColumn("led", F.explode(F.when(F.col("m") > 1, F.array(one, more)).otherwise(F.array(one))))
    return out.select(F.when(F.col("named"), F.col("key")).alias("doc_id"), "text", "led.*"), placed.agg(F.max("m")).first()[0] or 0


def repeated(rows: DataFrame, most: int, spread: int) -> DataFrame:
    """As many of each row as its column ``copies`` says, ``most`` at most; beyond ``spread`` of them several tasks write them."""
    names = [c for c in rows.columns if c != "copies"]
    several = lambda n: F.explode(F.sequence(F.lit(1).cast("long"), n))
    if most <= 1:
        return rows.select(*names)
    if most <= spread:
        return rows.withColumn("copy", several(F.col("copies"))).select(*names)
    rows = shared.materialise(rows, "merkle")
    few = rows.where(F.col("copies") <= spread).withColumn("copy", several(F.col("copies"))).select(*names)
    lots = rows.where(F.col("copies") > spread).withColumn("lot", several(F.ceil(F.col("copies") / spread))).repartition("lot", *names)
    lots = lots.withColumn("copies", F.least(F.lit(spread).cast("long"), F.col("copies") - (F.col("lot") - 1) * spread))
    return few.unionByName(lots.withColumn("copy", several(F.col("copies"))).select(*names))


def edit_digest(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likenesses.

    The edited text has its last half (rounded down) replaced by as many code points
    of the next document's beginning.
    """
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    pairs, most = with_next(docs)
    pairs = pairs.withColumn("edited", F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half)))
    grown = pairs.select("*", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), *[tree(F.col(c)).alias(f"tree_{c}") for c in ("text", "edited", "next_text")])
    near = lambda other: likeness(F.col("text"), F.col("tree_text"), F.col(other), F.col(f"tree_{other}"))
    found = grown.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("tree_text")).alias("fingerprint"), fingerprint(F.col("tree_edited")).alias("edited_fingerprint"),
        near("edited").alias("near_edited"), near("next_text").alias("near_next"), "copies",
    )
    return repeated(found, most, SPREAD)
