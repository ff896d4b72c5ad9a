"""Operator 8, line dedup by a segment-partition edit join. DataFrame functions only.

Lines are the parts of a text between newlines, unchanged; a line's words are its parts between single spaces. Two lines are
near-duplicates if they are equal, or if their edit distance in whole words (a word replaced, added or left out) is at most
``edits_of(n)``, n being the words of the shorter line: 0 below 5 words, 1 below 10 (so that a similarity of 0.8 is kept), 2
from 10 words on and from 144 on the root of n / 16, up to 30. Classes are what such links connect.

* Each distinct line of n words is cut into edits_of(n) + 1 segments. So many edits leave one segment intact, so the other line
  has it as a run of words near its place: of the runs of the longer line only those that the multi-match-aware rule allows are
  probed, for each length from n on that the threshold allows. Segments and runs meet by 64-bit hash.
* The least and the greatest line of each key come first, with map-side combine; only lines that share a key with another line go
  on, by a join that adaptive execution can split. Their texts are fetched once, through a bit filter of bounded size.
* Lines that share a key of at most ``GROUP`` lines are compared with each other. In a larger group every line is compared with
  the group's most copied segment line only, one row a line. Where that leaves a group in one component, nothing is missing; in
  the others lines of different components are compared, and then all is done. Pairs whose numbers of words, or parities of
  the counts of words in 128 classes, differ by more than the threshold allows make no rows: that is part of the joins' conditions.
* Candidates are verified by a banded bit-parallel edit distance: two words of 2 k + 1 bits hold the vertical differences of the
  band, advanced a word of the line at a time.
* Copies, however many, leave a key's least and greatest line as they are, so texts aren't exchanged to make keys of distinct lines
  only; later they meet as one by a 128-bit hash in an aggregation with map-side combine.

A place is (doc_id, line number, 64-bit hash of the text), so that rows sharing a doc_id but not their text stay apart; rows
that share both are one document. A null text has no line; an empty text has one empty line. Rows with a null doc_id have
classes of their own and count in no class. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import GROUP, components, linked, saved, sifted, unused

SIMILAR = 5  # words for each edit of a short line
TWO = 2 * SIMILAR
LONG = 144
ROOT = 16
MOST = 30  # the band of 61 diagonals fits one long
BITS = ("bits0", "bits1")
PLACE = ("doc_id", "line_no", "row")


def edits_of(n: str) -> str:
    """SQL for the edits that a line of n (SQL) words allows."""
    grown = f"cast(least({MOST}, floor(sqrt(({n}) / {ROOT}))) as int)"
    return f"case when ({n}) < {SIMILAR} then 0 when ({n}) < {TWO} then 1 when ({n}) < {LONG} then 2 else {grown} end"


def with_keys(lines: DataFrame) -> DataFrame:
    """(ha, key, own) of lines (ha, line): a row for each key of those of SIMILAR words or more, and whether it is a segment of the line
    itself. A key that stands in a line twice has two rows. All of it is generated code that splits a line into words once.

    A line of n words has the keys of its own segments, edits_of(n) + 1, and of the runs that it only probes: segments of lines of
    m = n - d words, d edits at most. Of a line's m words, segments have m div q, the last m mod q of them one more, q = e + 1, e
    being edits_of(m). Segment i may lie s words further right in a longer line, if neither what comes before it nor what comes
    after needs too many edits.
    """
    rows = lines.select("ha", F.split("line", " ", -1).alias("words")).withColumn("n", F.size("words"))
    # not outer, Spark would make each sequence once more to see that it isn't empty
    rows = rows.select("*", F.explode_outer(F.expr(f"sequence(0, {edits_of('n')})")).alias("d"))
    rows = rows.withColumn("m", F.expr("n - d")).withColumn("e", F.expr(edits_of("m"))).where("e >= d and e > 0")
    rows = rows.withColumns({"size": F.expr("m div (e + 1)"), "less": F.expr("e + 1 - m % (e + 1)")})  # segments from less on have one word more
    rows = rows.select("*", F.explode_outer(F.expr("sequence(0, e)")).alias("i"))
    rows = rows.select("*", F.explode_outer(F.expr("sequence(greatest(-i, d - (e - i)), least(i, d + (e - i)))")).alias("s"))
    run = "slice(words, cast(i * size + greatest(0, i - less) + s + 1 as int), cast(size + if(i >= less, 1, 0) as int))"
    return rows.select("ha", F.expr(f"xxhash64(m, i, {run})").alias("key"), F.expr("d = 0 and s = 0").alias("own"))


def word_bits(classes: str = "classes") -> list[Column]:
    """Longs whose bits say of which of 64 classes of words each (``word_classes``) the line has an odd number. An edit of a word changes two at most."""
    return [F.expr(f"aggregate({classes}, 0L, (c, x) -> if(x div 64 = {k}, c ^ shiftleft(1L, x % 64), c))") for k in range(len(BITS))]


def word_classes(words: Column) -> Column:
    """The class of each of the words."""
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(64 * len(BITS))).cast("int"))


def within(a: str, b: str, k: str) -> Column:
    """True if the edit distance of the arrays a and b (SQL) is at most k (SQL, at most MOST), in words or whatever they hold.

    A band of the table of distances is kept as bits: bit d stands for the cell d - k places above a's diagonal. up and down say
    where the distance grows or falls by one from the cell above; the distance itself is followed along the diagonal on which
    both arrays end. A step takes in one element of b.
    """
    full = "(shiftleft(1L, 2 * p.k + 1) - 1)"
    same = "aggregate(sequence(0, 2 * p.k), 0L, (m, d) -> if(get(p.a, j - p.k + d) <=> get(p.b, j) and get(p.a, j - p.k + d) is not null, m | shiftleft(1L, d), m))"
    zero = "(((((q.same & t.up) + t.up) ^ t.up) | q.same | t.down) & " + full + ")"
    up = f"((t.down | ~(q.zero | t.up)) & {full})"
    moved = (
        f"named_struct('up', ((q.zero & t.up) | ~(shiftrightunsigned(q.zero, 1) | {up})) & {full}, 'down', shiftrightunsigned(q.zero, 1) & {up}, "
        "'far', t.far + if((shiftrightunsigned(q.zero, size(p.a) - size(p.b) + p.k) & 1) = 1, 0, 1))"
    )
    bound = lambda name, value, body: f"element_at(transform(array(named_struct('{name}', {value})), q -> {body}), 1)"  # noqa: E731  evaluates value once
    step = f"if(t.far > p.k, t, {bound('same', same, bound('zero', zero, moved))})"
    first = "named_struct('up', shiftleft(shiftleft(1L, p.k + 1) - 1, p.k), 'down', shiftleft(1L, p.k) - 1, 'far', abs(size(p.a) - size(p.b)))"
    steps = f"aggregate(filter(sequence(0, size(p.b)), j -> j < size(p.b)), {first}, (t, j) -> {step})"
    return F.expr(f"element_at(transform(array(named_struct('a', {a}, 'b', {b}, 'k', {k})), p -> abs(size(p.a) - size(p.b)) <= p.k and {steps}.far <= p.k), 1)")


def surely(a: str, b: str, k: str) -> Column:
    """True only if ``within`` is: the words that differ place by place, or those between the equal ones at both ends, are k at most."""
    same = lambda x, y: f"zip_with({x}, {y}, (p, q) -> p <=> q)"  # noqa: E731  false beyond the shorter one's end
    run = lambda x, y: f"array_position({same(x, y)}, false) - 1"  # noqa: E731  -1: all are equal
    by_place = f"size(filter({same(a, b)}, x -> not x)) <= {k}"
    between = f"greatest(size({a}), size({b})) - least(size({a}), size({b}), {run(a, b)} + {run(f'reverse({a})', f'reverse({b})')}) <= {k}"
    return F.expr(f"({by_place}) or ({between})")


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, row, line) of every text of docs (doc_id, text); row is a hash of the text."""
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).select(*PLACE, "line")


def named(docs: DataFrame) -> DataFrame:
    """lines with ha, hb: 128 bits that stand for the line."""
    return lines(docs).withColumns({"ha": F.xxhash64("line"), "hb": F.xxhash64(F.lit(1), F.col("line"))})


def sharing(docs: DataFrame) -> DataFrame:
    """(key, ha, own, n) of the lines (by ha) that have a key with others: own if one of its segments has it, n lines in all."""
    # copies of a line leave the least and the greatest of a key's lines as they are, so no text is exchanged to count a line once
    keyed = with_keys(lines(docs.where("doc_id is not null")).select(F.xxhash64("line").alias("ha"), "line"))
    shared = keyed.groupBy("key").agg(F.min("ha").alias("p"), F.max("ha").alias("q"), F.max("own").alias("some")).where("p <> q and some")
    shared = saved(shared.select("key"), "line-shared-keys")  # it is read twice
    rows = sifted(keyed, "key", shared).join(shared, "key").groupBy("key", "ha").agg(F.max("own").alias("own"))
    rows = saved(rows.select("key", "ha", "own"), "line-key-rows")
    return saved(rows.join(rows.groupBy("key").agg(F.count("*").alias("n")), "key"), "line-keys")


def links(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """Links (a, b) that connect all distinct lines within the threshold of each other, named by their first places and hashes:
    struct<doc_id,line_no,row,ha,hb>."""
    rows = sharing(docs)
    marks = sifted(named(docs.where("doc_id is not null")), "ha", rows.select("ha")).groupBy("ha", "hb")
    marks = marks.agg(F.min(F.struct(*PLACE)).alias("id"), F.first("line").alias("line"), F.count("*").alias("weight"))
    marks = saved(marks.select("ha", F.struct("id.*", "ha", "hb").alias("id"), "line", "weight"), "line-marks")
    known = marks.select("ha", "id", "weight", word_classes(F.split("line", " ", -1)).alias("classes"))
    known = known.select("ha", "id", "weight", F.size("classes").alias("words"), *(c.alias(x) for x, c in zip(BITS, word_bits())))
    rows = rows.join(known, "ha").withColumnRenamed("ha", "ref")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        pairs = saved(pairs.distinct(), f"{name}-asked")
        asked = pairs.select(F.col("a").alias("ha")).union(pairs.select("b"))
        texts = sifted(marks.select("ha", "id", "line"), "ha", asked)
        left, right = (texts.withColumnsRenamed({"ha": x, "id": f"id_{x}", "line": f"line_{x}"}) for x in "ab")
        both = pairs.join(left, "a").join(right, "b").select("id_a", "id_b", F.split("line_a", " ", -1).alias("x"), F.split("line_b", " ", -1).alias("y"))
        k = edits_of("least(size(x), size(y))")
        return saved(both.where(surely("x", "y", k) | within("x", "y", k)).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")), name)

    edits = F.expr(edits_of("least(words_a, words_b)"))
    differ = reduce(lambda p, q: p + q, (F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in BITS))
    alike = (F.abs(F.col("words_a") - F.col("words_b")) <= edits) & (differ <= 2 * edits)
    return linked(rows, ("words", *BITS), alike, verified, "lines", group)


def classes(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """(doc_id, line_no, class_doc_id, class_line_no, kept, row, class_row) for every line: its class is named by the first place,
    by doc_id, line number and row, of any line in it; that line alone is kept."""
    near = components(links(docs, group), "line-classes")
    near = near.select("node.ha", "node.hb", F.struct(*(f"component.{c}" for c in PLACE)).alias("component"))
    every = named(docs).select(*PLACE, "ha", "hb")
    id_ = F.struct(*PLACE)
    first = every.where("doc_id is not null").groupBy("ha", "hb").agg(F.min(id_).alias("id"))
    first = first.join(near, ["ha", "hb"], "left").select("ha", "hb", F.coalesce("component", "id").alias("class"))
    out = every.join(first, ["ha", "hb"], "left").withColumn("class", F.when(F.col("doc_id").isNotNull(), F.col("class")))
    named_by = [F.col(f"class.{c}").alias(f"class_{c}") for c in PLACE]
    return out.select("doc_id", "line_no", *named_by[:2], F.coalesce(F.col("class") == id_, F.lit(True)).alias("kept"), "row", named_by[2])


def dedup(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """docs (doc_id, text, ...) without the lines that are not the first of their class, empty ones included.

    Texts that lose every line become empty; null texts and rows with a null doc_id stay as they are. Of rows that share a doc_id,
    each loses only lines of its own text; rows that share the text too are treated alike.
    """
    doc, row, gone = (unused(docs, n) for n in ("_doc", "_row", "_gone"))
    drop = classes(docs, group).where("not kept").groupBy(F.col("doc_id").alias(doc), F.col("row").alias(row)).agg(F.collect_set("line_no").alias(gone))
    both = docs.join(drop, (docs.doc_id.cast("long") == F.col(doc)) & (F.xxhash64(docs.text) == F.col(row)), "left")
    stay = F.filter(F.split(docs.text, "\n", -1), lambda x, i: ~F.array_contains(F.col(gone), i))
    text = F.when(F.col(gone).isNull(), docs.text).otherwise(F.array_join(stay, "\n"))
    return both.select(*(text.alias(c) if c == "text" else docs[c] for c in docs.columns))
