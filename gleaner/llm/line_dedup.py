"""Fuzzy line deduplication in DataFrame operations only: MinHash, banding, exact Jaccard, distributed union-find.

Lines are compared lower-cased with white space runs as one space. A line's set is its shingles of ``SHINGLE``
characters (a shorter line is one shingle). Their hashes are dealt into ``BINS`` bins, and the least of each bin is one
MinHash value. Hashes that are unlikely to be least are left out first: those below a bound that keeps about ``SAMPLE``
of a line's hashes are enough, as the least of a bin is among them or the bin counts as empty, in similar lines alike. A line that repeats so few
shingles that its sample fills few bins takes all of them.
``ROWS`` neighbouring bins make a band, and lines that agree in a band are candidates: at the threshold of 0.8 two lines
miss all bands with a chance of about 0.3 %, at 0.9 of one in 20,000. Every candidate pair that decides anything is
verified by the Jaccard coefficient of all their shingles, which are told apart by 64-bit hashes as the lines are.

A line's bitmap has 1,024 bits; each of its distinct shingles flips one. Shingles that two lines share flip the same bits,
so their bitmaps differ in at most as many bits as they differ in shingles, and long lines' bitmaps don't fill up. Lines
whose bitmaps differ in more bits than lines at the threshold may differ in shingles are no pair; the bound is exact, so
no link is lost by it.

Pairs of a band are not listed. First each member is verified against the band's smallest line, which then leaves the
band. Bands whose members lie in one component are done. In the others members of other components are verified with a
member drawn by hash, which leaves too, ``PIVOTS`` times, and in bands of more than ``LARGE`` members as long as that
finds links, in ``ROUNDS`` rounds at most: components grow together, and most of a large group of near copies becomes one in as many pairs as it has
members. Only in bands that are still mixed are members of different components verified with each other, each pair in
one of its bands, so every candidate link is found or is already implied. Equal lines are one line before any of this.

Defined results: null texts have no lines; blank lines are kept and never grouped; a component keeps its smallest
(doc_id, line_no), ids that are null last; of repeated rows the first copy. Distinct lines are told apart by a 64-bit
hash. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import SPACE, small, written
from gleaner.llm.components import components

SHINGLE = 8
SAMPLE = 96
BINS = 24
FILLED = 20
ROWS = 3
THRESHOLD = 0.8
WORDS = 16
PIVOTS = 1
LARGE = 1024
ROUNDS = 6


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, norm (null for a blank line), line_id."""
    split = docs.select("doc_id", F.posexplode(F.split(F.col("text"), "\n")).alias("line_no", "line"))
    line = F.col("line")
    # Only a line with white space other than single spaces needs the pattern.
    odd = F.lit(False)
    for space in ("  ", "\t", "\r", "\x0b", "\x0c"):
        odd = odd | F.contains(line, F.lit(space))
    norm = F.trim(F.lower(F.when(odd, F.regexp_replace(line, SPACE, " ")).otherwise(line)))
    return split.select("doc_id", "line_no", F.nullif(norm, F.lit("")).alias("norm")).withColumn(
        "line_id", F.when(F.col("norm").isNotNull(), F.xxhash64("norm")))


def bands(found: DataFrame, sampled: bool) -> DataFrame:
    """line_id, key: one row for each band of a line that isn't empty; ``found`` may hold a line many times.

    Shingles are exploded, hashed, sampled and brought to minima within one stage of generated code; repeated lines
    merge in the partial aggregation, and only the minima cross the shuffle. Of a sampled line that fills fewer than
    ``FILLED`` bins, as it repeats few shingles, the one row has a null key: it takes all its hashes."""
    units = found.select("line_id", F.encode("norm", "UTF-16BE").alias("units"))
    counted = units.withColumn("n", F.expr(f"greatest(octet_length(units) div 2 - {SHINGLE - 1}, 1)"))
    each = counted.select("line_id", "units", "n", F.explode(F.expr("sequence(0, n - 1)")).alias("i"))
    hashed = each.select("line_id", "n", "i", F.expr(f"xxhash64(substring(units, 2 * i + 1, {2 * SHINGLE}))").alias("h"))
    valued = hashed.select("line_id", "n", "i", F.expr(f"pmod(h, {BINS}L)").alias("bin"), F.expr("shiftrightunsigned(h, 33)").alias("value"))
    if sampled:
        # The first shingle stays as a row of its line, but outside the sample it is in no bin.
        inside = F.expr(f"value * n < {SAMPLE << 31}L")
        valued = valued.filter(inside | (F.col("i") == 0)).withColumn("bin", F.when(inside, F.col("bin")))
    least = valued.groupBy("line_id").agg(
        F.max("n").alias("n"), *[F.min(F.when(F.col("bin") == b, F.col("value"))).alias(f"m{b}") for b in range(BINS)])
    keys = []
    for band in range(BINS // ROWS):
        values = [F.col(f"m{b}") for b in range(band * ROWS, (band + 1) * ROWS)]
        key = F.xxhash64(F.lit(band), *[F.coalesce(v, F.lit(-1)) for v in values])
        keys.append(F.when(F.coalesce(*values).isNotNull(), key))
    every = F.array_compact(F.array(*keys))
    if sampled:
        filled = sum((F.col(f"m{b}").isNotNull().cast("int") for b in range(1, BINS)), F.col("m0").isNotNull().cast("int"))
        weak = (F.col("n") > SAMPLE) & (filled < FILLED)
        every = F.when(weak, F.array(F.lit(None).cast("long"))).otherwise(every)
    return least.select("line_id", F.explode(every).alias("key"))


def shingles(norm: str) -> Column:
    """The shingles of a line, as hashes; a short line is one shingle. Code points have four bytes in UTF-32, so a shingle
    is found by its place; the outer transform only names the encoded line, which is computed and held once."""
    places = f"sequence(1, greatest(octet_length(u) - {4 * SHINGLE - 1}, 1), 4)"
    return F.expr(f"transform(array(encode({norm}, 'UTF-32')), u -> transform({places}, i -> xxhash64(substring(u, i, {4 * SHINGLE}))))[0]")


def sketched(lines: DataFrame) -> DataFrame:
    """line_id, norm, size and a bitmap of ``WORDS`` longs of each line once; every distinct shingle flips one bit of the bitmap."""
    once = lines.dropDuplicates(["line_id"])
    # A generator would compute the set by its slower, interpreted form.
    each = once.select("line_id", F.array_distinct(shingles("norm")).alias("set")).select("line_id", F.explode("set").alias("h"))
    # First one word at a time: an aggregate of every word for each shingle costs several times as much.
    bits = each.select("line_id", F.expr(f"pmod(h, {WORDS}L)").alias("w"), F.expr("shiftleft(1L, int(shiftrightunsigned(h, 58)))").alias("bit"))
    words = bits.groupBy("line_id", "w").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("bit").alias("bits"))
    marked = words.groupBy("line_id").agg(F.sum("n").cast("int").alias("size"), *[
        F.coalesce(F.max(F.when(F.col("w") == w, F.col("bits"))), F.lit(0).cast("long")).alias(f"b{w}") for w in range(WORDS)])
    return once.select("line_id", "norm").join(marked, "line_id")


def may_be_similar(a: str, b: str, threshold: float) -> Column:
    """False only for lines that can't be: of sizes n and m, lines at the threshold t differ in at most
    (1 - t) / (1 + t) * (n + m) shingles, and their bitmaps in no more bits than that."""
    sizes = F.least(f"{a}.size", f"{b}.size") >= threshold * F.greatest(f"{a}.size", f"{b}.size")
    differ = F.expr(" + ".join(f"bit_count({a}.b{w} ^ {b}.b{w})" for w in range(WORDS)))
    most = (1 - threshold) / (1 + threshold) * (F.col(f"{a}.size") + F.col(f"{b}.size"))
    return sizes & (differ <= most + 1e-6)


def similar(pairs: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) whose lines' shingle sets have at least this Jaccard coefficient; ``found`` is sketched."""
    left, right = found.withColumnRenamed("line_id", "u").alias("l"), found.withColumnRenamed("line_id", "v").alias("r")
    both = pairs.join(left, "u").join(right, "v").filter(may_be_similar("l", "r", threshold))
    common = F.size(F.array_intersect(shingles("l.norm"), shingles("r.norm")))
    # Written before it is filtered: a pushed condition would compute the sets for each mention.
    counted = both.select("u", "v", F.col("l.size").alias("n"), F.col("r.size").alias("m"), common.alias("common"))
    counted = written(counted, "common-shingles")
    return counted.filter(F.col("common") >= threshold * (F.col("n") + F.col("m") - F.col("common"))).select("u", "v")


def pivot_pairs(members: DataFrame, drawn: DataFrame, threshold: float) -> DataFrame:
    """u, v: of each band the ``drawn`` member (key, pivot) with the members of other components that may be similar."""
    pivot = members.join(drawn, "key").filter("line_id = pivot").drop("pivot")
    hopeful = (F.col("a.key") == F.col("b.key")) & (F.col("a.root") != F.col("b.root")) & may_be_similar("a", "b", threshold)
    return members.alias("a").join(pivot.alias("b"), hopeful).select(
        F.least("a.line_id", "b.line_id").alias("u"), F.greatest("a.line_id", "b.line_id").alias("v")).distinct()


def other_pairs(members: DataFrame, threshold: float) -> DataFrame:
    """u, v: members of a band and of several components that may be similar. Lines that share several bands are paired in
    the least of them only; where that band was left out, they were verified there or lie in one component."""
    a, b = members.alias("a"), members.alias("b")
    hopeful = (F.col("a.key") == F.col("b.key")) & (F.col("a.root") < F.col("b.root")) & may_be_similar("a", "b", threshold)
    once = F.col("a.key") == F.array_min(F.array_intersect("a.keys", "b.keys"))
    return a.join(b, hopeful & once).select(
        F.least("a.line_id", "b.line_id").alias("u"), F.greatest("a.line_id", "b.line_id").alias("v"))


def merged(found: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``found`` (node, root) with the links ``more`` (u, v), and old and new root of the components that these join."""
    roots = more
    for end in ("u", "v"):
        known = found.select(F.col("node").alias(end), "root")
        roots = roots.join(known, end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
    joined = written(components(roots.select("u", "v")), "joined-components")
    to = joined.select(F.col("node").alias("root"), F.col("root").alias("new"))
    old = found.join(to, "root", "left").select("node", F.coalesce("new", "root").alias("root"))
    return written(old.union(joined.join(found, "node", "left_anti").select("node", "root")), "components"), to


def still_mixed(members: DataFrame) -> DataFrame:
    """The members of bands with several components."""
    mixed = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
    return members.join(small(written(mixed, "mixed-bands")), "key")


def groups(occurrences: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """node, root of the lines that are linked to others; ``occurrences`` has norm and line_id."""
    known = occurrences.filter("norm is not null").select("norm", "line_id")
    first = written(bands(known, True), "bands")
    weak = written(first.filter("key is null").select("line_id"), "weak-lines")
    again = known.join(small(weak, width=16), "line_id", "left_semi")
    banded = first.filter("key is not null").union(written(bands(again, False), "weak-bands"))
    sizes = banded.groupBy("key").agg(F.min("line_id").alias("first"), F.max("line_id").alias("last")).filter("first <> last")
    shared = written(sizes.select("key", "first"), "shared-bands")
    members = written(banded.join(small(shared), "key"), "band-members")
    star = written(members.filter("line_id <> first").select(F.col("first").alias("u"), F.col("line_id").alias("v")).distinct(), "star-pairs")
    # The text of lines with a candidate; all later lookups read this part.
    text = known.join(small(written(members.select("line_id").distinct(), "candidates"), width=16), "line_id", "left_semi")
    text = written(sketched(text), "candidate-lines")
    linked = similar(star, text, threshold)
    found = written(components(linked), "components")
    # A band's smallest line is verified against all others, so only these are left in it.
    rest = members.filter("line_id <> first").join(small(found), F.col("line_id") == F.col("node"), "left").select(
        "key", "line_id", F.coalesce("root", "line_id").alias("root"))
    rest = written(still_mixed(written(rest, "named-members")), "mixed-lines")
    keys = rest.groupBy("line_id").agg(F.collect_set("key").alias("keys"))
    apart = written(rest.join(keys, "line_id").join(text.drop("norm"), "line_id"), "mixed-members")
    turn, among = 0, apart
    while turn < PIVOTS or not among.isEmpty():
        drawn = written(among.groupBy("key").agg(F.min_by("line_id", F.xxhash64("line_id", "key", F.lit(turn))).alias("pivot")), "pivots")
        more = written(similar(written(pivot_pairs(among, drawn, threshold), "pivot-pairs"), text, threshold), "pivot-links")
        none = more.isEmpty()
        moved = apart.join(small(drawn), "key", "left").filter("pivot is null or line_id <> pivot").drop("pivot")
        if not none:
            found, to = merged(found, more)
            moved = moved.join(small(to), "root", "left").withColumn("root", F.coalesce("new", "root")).drop("new")
        apart = written(still_mixed(written(moved, "moved-members")), "mixed-members")
        turn += 1
        if none or turn == ROUNDS:
            break
        among = apart.join(small(written(apart.groupBy("key").count().filter(F.col("count") > LARGE).select("key"), "large-bands")), "key")
    more = similar(written(other_pairs(apart, threshold), "mixed-pairs"), text, threshold)
    if more.isEmpty():
        return found
    return merged(found, more)[0]


def decided(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, line_no, kept, keep_doc_id, keep_line_no, group_size: one row for each line of each row."""
    split = written(lines(docs), "lines")
    rows = written(split.groupBy("doc_id", "line_no", "line_id").agg(F.count(F.lit(1)).alias("n")), "line-rows")
    found = groups(split, threshold)
    rooted = rows.join(small(found), rows["line_id"] == found["node"], "left").select(
        "doc_id", "line_no", "n", F.coalesce("root", "line_id").alias("root"))
    rooted = written(rooted, "rooted-lines")
    filled = rooted.filter("root is not null")
    least = filled.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "line_no")).alias("k"), F.sum("n").alias("group_size"))
    judged = filled.join(least, "root").select("doc_id", "line_no", "n", F.col("k.doc_id").alias("keep_doc_id"), F.col("k.line_no").alias("keep_line_no"), "group_size")
    first = F.col("doc_id").eqNullSafe(F.col("keep_doc_id")) & (F.col("line_no") == F.col("keep_line_no")) & (F.col("copy") == 1)
    copies = judged.withColumn("copy", F.explode(F.expr("sequence(1, int(n))"))).select(
        "doc_id", "line_no", first.alias("kept"), "keep_doc_id", "keep_line_no", "group_size")
    blank = rooted.filter("root is null").select(
        "doc_id", "line_no", F.lit(True).alias("kept"), F.col("doc_id").alias("keep_doc_id"), F.col("line_no").alias("keep_line_no"),
        F.lit(1).cast("long").alias("group_size"), F.explode(F.expr("sequence(1, int(n))")).alias("copy")).drop("copy")
    return copies.unionByName(blank)


def cleaned(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """``docs``, whose ids are distinct, with the lines that don't stay taken out of ``text``."""
    gone = decisions.filter(~F.col("kept")).groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set("line_no").alias("__gone"))
    joined = docs.join(gone, docs["doc_id"].eqNullSafe(gone["__id"]), "left")
    left = F.array_join(F.expr("filter(split(text, '\\n'), (x, i) -> not array_contains(__gone, i))"), "\n")
    text: Column = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(left)
    return joined.withColumn("text", text).select(*[F.col(f"`{c}`") for c in docs.columns])
