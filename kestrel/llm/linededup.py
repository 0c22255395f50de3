"""Line dedup by an exact set-similarity join, in DataFrame operations only.

A line is the set of its words. Words are ordered by rarity: the number of
words in their hash bucket (2^20 buckets, a fixed table), then hash. Equal
lines are one class. Two sets with Jaccard >= t share a word among their
first few (prefix filter); the shorter one's prefix can be shorter still,
lengths must be within t, the words' positions must leave room for the
overlap (positional filter), and parity sketches of 128, then 256 bits bound
the difference of the sets. What is left is verified on the words themselves. A line goes if
it is not the first of its class, or if a line of another class that matches
it comes earlier.

Many near copies of one line would make a row for every two of them. So each
class is first compared with a few others of the lists of two of its prefix
words; classes that these links connect are a group. Large groups are cut into
blocks, and two blocks are compared in one row, which counts links without
a row for each. Only pairs of classes in different groups become rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.llm.common import components, discard, row_id, stored, unused

SIMILARITY = 0.8
BUCKETS = 1 << 20
SPACE = "\t\x0b\x0c\r"
SENT = 2_000_000  # class numbers that are broadcast at most (16 MB); more are joined by shuffles
AHEAD = (1, 2, 5)  # how far before it in a word's list a class looks for one of its group
LOOKED = 2  # prefix words of a class in whose lists it looks
PARTS = 4  # the prefix words are joined in so many parts (a power of 2)
TELLING = 128  # words of a line up to which a sketch of 128 bits tells enough to connect a group
MANY = 16  # classes of a group that are compared in blocks; pairs of smaller groups become rows
ROW_COST = 32  # comparisons within blocks that cost about as much as a row of candidates
BLOCK = 1 << 14  # words of a block, about


def split(line: Column) -> Column:
    """Parts of a line between white space (9 to 13 and 32)."""
    odd = F.lit(False)
    for c in SPACE:
        odd = odd | F.contains(line, F.lit(c))
    plain = F.when(odd, F.translate(line, SPACE, " " * len(SPACE))).otherwise(line)
    return F.split(plain, " ")


def words(line: Column) -> Column:
    """Words of a line: its parts that are not empty."""
    return F.array_remove(split(line), "")


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, line_no, line, k1, k2): the lines with words, from 0. Rows equal in doc_id and text are one document."""
    return (docs.select(F.col("doc_id").cast("long"), row_id().alias("rid"), F.col("text").cast("string"))
            .select("doc_id", "rid", F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line"))
            .where(F.ltrim("line", F.lit(SPACE + " ")) != "")
            .select("*", F.xxhash64("line").alias("k1"), F.xxhash64("line", F.lit(2)).alias("k2")))


def class_lines(docs: DataFrame) -> DataFrame:
    """(c, line): the different lines."""
    return stored(lines(docs).select(F.xxhash64("k1", "k2").alias("c"), "line").distinct(), "line-classes", **{"parquet.block.size": 16 << 20})  # a writer holds that much text


def rarity(known: DataFrame) -> Column:
    """Scalar array: the rank of each hash bucket, about 512 log2 of its number of words in different lines, in the upper 16 bits."""
    spread = (known.select(F.explode_outer(split(F.col("line"))).alias("w")).where("w <> ''")
              .select(F.xxhash64("w").bitwiseAND(F.lit(BUCKETS - 1)).alias("bucket")))
    counts = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    every = known.sparkSession.range(BUCKETS).withColumnRenamed("id", "bucket").join(counts, "bucket", "left")
    rank = F.floor(F.log2(F.coalesce("n", F.lit(0)) + 1.0) * 512).cast("int")
    # a table of fixed size, whatever the input
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("bucket", rank.alias("r")))), lambda e: F.shiftleft(e["r"].cast("long"), 48)).alias("ranks")).scalar()


def need(a: Column, b: Column, t: float) -> Column:
    """Least overlap of sets of sizes a and b for Jaccard >= t."""
    return F.ceil((a + b) * F.lit(t / (1 + t)) - 1e-9)


def prefixes(known: DataFrame, t: float) -> DataFrame:
    """(c, size, even, odd, prefix): every class, its number of words, its sketch of 128 bits, its prefix words in order."""
    hashed = F.array_distinct(F.transform(words(F.col("line")), lambda w: F.xxhash64(w)))
    # rank in the upper bits, 48 bits of the hash below: rare words first
    ordered = F.sort_array(F.transform(hashed, lambda h: F.get("ranks", h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")).bitwiseOR(F.shiftrightunsigned(h, 16))))
    # the lower 6 bits tell the bit, the next one the half
    shifted = lambda one, x: F.call_function("shiftleft", one, x.bitwiseAND(F.lit(63)).cast("int"))
    parity = lambda one: F.aggregate("s", F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(shifted(one(x), x)))
    told = known.withColumn("ranks", rarity(known)).select("c", ordered.alias("s")).select(
        "c", F.size("s").alias("size"), parity(lambda x: F.lit(1).cast("long")).alias("all"),
        parity(lambda x: F.shiftright(x, 6).bitwiseAND(F.lit(1).cast("long"))).alias("odd"), F.slice("s", 1, (F.size("s") - F.ceil(F.size("s") * t - 1e-9) + 1).cast("int")).alias("prefix"))
    return stored(told.select("c", F.col("size").cast("long").alias("size"), F.col("all").bitwiseXOR(F.col("odd")).alias("even"), "odd", "prefix"), "line-prefixes")


POSTED = ("c", "shape", "even", "odd")


def part(name: str) -> dict:
    """The parts of a posting in the table ``name``."""
    of = {k: F.col(f"{name}.{k}") for k in POSTED}
    return of | {"size": F.shiftright(of["shape"], 32), "at": of["shape"].bitwiseAND(F.lit((1 << 32) - 1))}


def few_apart(a: dict, b: dict, t: float) -> Column:
    """Sets whose sketches differ in no more bits than sets with Jaccard >= t can."""
    differ = F.bit_count(a["even"].bitwiseXOR(b["even"])) + F.bit_count(a["odd"].bitwiseXOR(b["odd"]))
    return differ <= a["size"] + b["size"] - 2 * need(a["size"], b["size"], t)


def close(a: dict, b: dict, t: float) -> Column:
    """Two postings of a word, a of the smaller set: their sets may have Jaccard >= t by sizes, positions and sketches."""
    least = need(a["size"], b["size"], t)
    room = F.least(a["size"] - a["at"], b["size"] - b["at"])
    # a join condition over both sides, not a filter: so both sides read one shuffle
    short = (a["at"] <= a["size"] - need(a["size"], a["size"], t)) | (b["size"] < 0)
    return short & (a["size"] >= b["size"] * t - 1e-9) & (room + F.least(a["at"], b["at"]) >= least) & few_apart(a, b, t)


def neighbours(listed: DataFrame, t: float) -> DataFrame:
    """(p, q, long): q and classes shortly before it, or the first one, in the lists of q's LOOKED prefix words with the least hashes, if the sketches are close.

    long: the sketches of 128 bits tell too little of so many words.
    """
    told = ("c", "size", "even", "odd")
    order = Window.partitionBy("w").orderBy("size", "c")
    own = F.struct(*told)
    others = {f"x{k}": F.lag(own, k).over(order) for k in AHEAD} | {"y": F.first(own).over(order)}
    least = F.slice(F.sort_array(F.transform("prefix", lambda w: w.bitwiseAND(F.lit((1 << 48) - 1)))), 1, LOOKED)
    shown = listed.select(*told, F.explode(least).alias("w")).withColumns(others)
    of = lambda name: {k: F.col(f"{name}.{k}" if name else k) for k in told}
    near = [F.when((F.col(f"{n}.c") != F.col("c")) & (F.col(f"{n}.size") >= F.col("size") * t - 1e-9) & few_apart(of(n), of(""), t), F.col(f"{n}.c")) for n in others]
    return stored(shown.select(F.explode_outer(F.array(*near)).alias("p"), F.col("c").alias("q"), (F.col("size") > TELLING).alias("long")).where("p is not null").distinct(), "line-neighbours")


def groups(listed: DataFrame, known: DataFrame, t: float) -> DataFrame:
    """(c, g): the classes of groups that are compared in blocks.

    A group is connected by ``neighbours``, the plausible ones where the line is long. It has many classes, and
    comparing all of them costs less than the rows that its words' lists make.
    """
    links = neighbours(listed, t)
    short, long = links.where("not long").select("p", "q"), links.where("long").select("p", "q")
    tied = components(short.union(plausible(long, texts_of(known, ends_of(long)), t)).toDF("a", "b"))
    every = tied.union(tied.select("root", "root").distinct()).toDF("c", "g")
    large = stored(every.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MANY), "line-groups")
    members = stored(every.join(sent(large), "g").select("c", "g", "n"), "line-members")
    rows = listed.join(sent(members), "c").select("g", "n", F.explode("prefix").alias("w")).groupBy("w", "g").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("k"))
    dense = stored(rows.groupBy("g").agg(F.max("n").alias("n"), F.sum(F.col("k") * F.col("k")).alias("rows"))
                   .where(F.col("n") * F.col("n") <= F.col("rows") * ROW_COST).select("g"), "line-dense")
    return stored(members.join(sent(dense), "g").select("c", "g"), "line-grouped")


def sent(df: DataFrame) -> DataFrame:
    """A stored table, broadcast if it is short."""
    return F.broadcast(df) if df.count() <= SENT else df


def candidates(listed: DataFrame, grouped: DataFrame, t: float) -> DataFrame:
    """(p, q): classes of different groups that pass all filters, each pair once.

    One part of the words after another: a part's postings are shuffled and gone before the next one's.
    """
    marked = listed.join(sent(grouped), "c", "left").select("c", "size", "even", "odd", F.coalesce("g", "c").alias("g"), F.posexplode("prefix").alias("at", "w"))
    posted = marked.select("w", "c", (F.shiftleft("size", 32) + F.col("at")).alias("shape"), "even", "odd", "g")
    x, y = part("a"), part("b")
    ahead = (x["size"] < y["size"]) | ((x["size"] == y["size"]) & (x["c"] < y["c"]))
    pairs = []
    for k in range(PARTS):
        own = posted.where(F.col("w").bitwiseAND(F.lit(PARTS - 1)) == k)
        both = own.alias("a").join(own.alias("b"), (F.col("a.w") == F.col("b.w")) & (F.col("a.g") != F.col("b.g")) & ahead & close(x, y, t))
        pairs.append(stored(both.select(F.col("a.c").alias("p"), F.col("b.c").alias("q")).distinct(), "line-part"))
    return reduce(DataFrame.union, pairs).distinct()


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("p", "q")).alias("c"))


def texts_of(known: DataFrame, ids: DataFrame) -> DataFrame:
    """(c, line, n, sketches) of the classes in ``ids``: the line, its number of words, their parity at each of 256 bits."""
    text = known.join(sent(stored(ids.distinct(), "line-ids")), "c")

    def described(h):  # a lambda, so that the words are hashed once
        one = F.lit(1).cast("long")
        part = lambda k: F.aggregate(h, F.lit(0).cast("long"), lambda acc, x: F.when(
            F.shiftrightunsigned(x, 62) == k, acc.bitwiseXOR(F.call_function("shiftleft", one, x.bitwiseAND(F.lit(63)).cast("int")))).otherwise(acc))
        return F.struct(F.size(h).alias("n"), F.array(*[part(k) for k in range(4)]).alias("sketches"))

    hashed = F.array_distinct(F.transform(words(F.col("line")), lambda w: F.xxhash64(w)))
    return stored(text.select("c", "line", F.transform(F.array(hashed), described)[0].alias("d")).select("c", "line", "d.*"), "line-texts")


def plausible(pairs: DataFrame, texts: DataFrame, t: float) -> DataFrame:
    """The pairs whose 256-bit sketches differ in no more bits than sets with Jaccard >= t can."""
    side = lambda c, n: texts.select(F.col("c").alias(c), F.struct("n", "sketches").alias(n))
    both = pairs.join(side("p", "u"), "p").join(side("q", "v"), "q")
    return stored(both.where(alike(F.col("u"), F.col("v"), t)).select("p", "q"), "line-plausible")


def alike(u: Column, v: Column, t: float) -> Column:
    differ = sum((F.bit_count(u["sketches"][k].bitwiseXOR(v["sketches"][k])) for k in range(4)), F.lit(0))
    return differ <= u["n"] + v["n"] - 2 * need(u["n"], v["n"], t)


def group_blocks(grouped: DataFrame, texts: DataFrame, classes: DataFrame) -> DataFrame:
    """(g, cuts, block, size, b): the groups cut into blocks of about BLOCK words. A set is told by its difference from the group's root.

    With d(x) the words that x or the root has alone, and s(x) the number of
    those that both have, x and y share s(x) + s(y) - size + |d(x) and d(y)| words.
    """
    hashed = F.array_distinct(F.transform(words(F.col("line")), lambda w: F.xxhash64(w)))
    members = stored(grouped.join(texts, "c").join(classes.select("c", "first"), "c").select("g", "c", "n", "first", hashed.alias("words")), "line-group-texts")
    cuts = stored(members.groupBy("g").agg(F.ceil(F.sum("n") / BLOCK).alias("cuts")), "line-cuts")
    roots = members.where("c = g").select("g", F.col("words").alias("root"))
    blocks = (members.join(sent(cuts), "g").groupBy("g", "cuts", F.pmod("c", "cuts").alias("block"))
              .agg(F.collect_list(F.struct("c", "first", "n", "words")).alias("b")).join(roots, "g"))
    parts = F.transform("b", lambda x: F.struct(x["c"].alias("c"), x["first"].alias("first"), x["n"].alias("n"), F.array_except(x["words"], "root").alias("own"),
                                                F.array_except("root", x["words"]).alias("lost")))
    told = F.transform(parts, lambda x: F.struct(x["c"].alias("c"), x["first"].alias("first"), x["n"].alias("n"),
                                                 (x["n"] - F.size(x["own"])).alias("same"), F.concat(x["own"], x["lost"]).alias("differ")))
    return stored(blocks.select("g", "cuts", "block", F.size("root").alias("size"), told.alias("b")), "line-blocks")


def group_links(grouped: DataFrame, texts: DataFrame, classes: DataFrame, t: float) -> DataFrame:
    """(c, n_links, later): the classes of a group that match c, and whether one of them comes earlier. All are compared, on 64-bit word hashes."""
    blocks = group_blocks(grouped, texts, classes)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1))
    # few bytes and much work: as many tasks as there are partitions
    dealt = lambda df: df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "g", "i", "j")
    asked = dealt(blocks.select("g", "size", F.col("block").alias("i"), every.alias("j"), F.col("b").alias("a")))
    other = dealt(blocks.select("g", every.alias("i"), F.col("block").alias("j"), "b"))

    def matches(x, y):
        enough = lambda common: common >= t * (x["n"] + y["n"] - common) - 1e-9
        least = x["same"] + y["same"] - F.col("size")
        most = least + F.least(F.size(x["differ"]), F.size(y["differ"]))
        return (x["c"] != y["c"]) & enough(most) & (enough(least) | enough(least + F.size(F.array_intersect(x["differ"], y["differ"]))))

    def counted(x):
        none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(False).alias("later"))
        return F.struct(x["c"].alias("c"), F.aggregate("b", none, lambda acc, y: F.when(matches(x, y), F.struct(
            (acc["n"] + 1).alias("n"), (acc["later"] | (y["first"] < x["first"])).alias("later"))).otherwise(acc)).alias("links"))

    found = asked.join(other, ["g", "i", "j"]).select(F.explode(F.transform("a", counted)).alias("e"))
    return stored(found.groupBy("e.c").agg(F.sum("e.links.n").alias("n_links"), F.max("e.links.later").alias("later")), "line-group-links")


def verified(pairs: DataFrame, texts: DataFrame, t: float) -> DataFrame:
    """The pairs (p, q) of classes with Jaccard >= t, by their words."""
    both = pairs.join(texts.select(F.col("c").alias("p"), F.col("line").alias("u")), "p").join(
        texts.select(F.col("c").alias("q"), F.col("line").alias("v")), "q")

    def enough(w):  # a lambda, so that the words are split once
        common = F.size(F.array_intersect(w["u"], w["v"]))
        return common >= t * (F.size(w["u"]) + F.size(w["v"]) - common) - 1e-9

    sets = F.struct(F.array_distinct(words(F.col("u"))).alias("u"), F.array_distinct(words(F.col("v"))).alias("v"))
    return stored(both.select("p", "q", F.transform(F.array(sets), enough)[0].alias("enough")).where("enough").drop("enough"), "line-links")


def placed(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(p, q, f): p's class comes first, f is its place."""
    first = classes.select("c", "first")
    both = pairs.join(first.select(F.col("c").alias("p"), F.col("first").alias("f1")), "p").join(
        first.select(F.col("c").alias("q"), F.col("first").alias("f2")), "q")
    swap = F.col("f2") < F.col("f1")
    return both.select(F.when(swap, F.col("q")).otherwise(F.col("p")).alias("p"), F.when(swap, F.col("p")).otherwise(F.col("q")).alias("q"),
                       F.least("f1", "f2").alias("f"))


def later_classes(pairs: DataFrame, texts: DataFrame, grouped: DataFrame, classes: DataFrame, t: float) -> DataFrame:
    """(c): classes that match an earlier one. Outside its group each is compared with its first candidate, and with all only if that fails."""
    inside = group_links(grouped, texts, classes, t).where("later").select("c")
    pairs = stored(placed(plausible(pairs, texts, t), classes), "line-placed")
    hit = verified(pairs.groupBy("q").agg(F.min_by("p", "f").alias("p")), texts, t).select("q")
    rest = verified(pairs.select("p", "q").join(hit, "q", "left_anti"), texts, t)
    return hit.union(rest.select("q")).union(inside).distinct().withColumnRenamed("q", "c")


def compared(docs: DataFrame, t: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The candidates of different groups, the texts to compare, the groups."""
    known = class_lines(docs)
    listed = prefixes(known, t)
    grouped = groups(listed, known, t)
    pairs = stored(candidates(listed, grouped, t), "line-pairs")
    discard(listed)
    texts = texts_of(known, ends_of(pairs).union(grouped.select("c")))
    discard(known)
    return pairs, texts, grouped


def occurrences_and_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    occurrences = stored(lines(docs).drop("line"), "lines")
    classes = occurrences.groupBy("k1", "k2").agg(F.min(place()).alias("first")).withColumn("c", F.xxhash64("k1", "k2"))
    return occurrences, stored(classes, "line-firsts")


def place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id"), F.col("rid"), F.col("line_no"))


def firsts_of(classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(c, first) of the classes that are compared."""
    return stored(classes.select("c", "first").join(sent(texts.select("c")), "c"), "line-places")


def remove_marks(docs: DataFrame, t: float = SIMILARITY) -> DataFrame:
    """One row per line with words: doc_id, rid, line_no, class_doc, class_line, n_links, removed.

    Class: the place (smallest doc_id, line number) of the first equal line.
    n_links: other classes with Jaccard >= t.
    """
    occurrences, classes = occurrences_and_classes(docs)
    pairs, texts, grouped = compared(docs, t)
    firsts = firsts_of(classes, texts)
    links = placed(verified(plausible(pairs, texts, t), texts, t), firsts)
    ends = links.select(F.explode(F.array(F.struct(F.col("p").alias("c"), F.lit(False).alias("later")),
                                          F.struct(F.col("q").alias("c"), F.lit(True).alias("later")))).alias("e")).select("e.*")
    ends = ends.select("c", F.lit(1).cast("long").alias("n_links"), "later").union(group_links(grouped, texts, firsts, t))
    linked = ends.groupBy("c").agg(F.sum("n_links").alias("n_links"), F.max("later").alias("later"))
    known = classes.join(linked, "c", "left").select("k1", "k2", "first", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("later", F.lit(False)).alias("later"))
    return occurrences.join(known, ["k1", "k2"]).select(
        "doc_id", "rid", "line_no", F.col("first.doc_id").alias("class_doc"), F.col("first.line_no").alias("class_line"), "n_links",
        (F.col("later") | (place() != F.col("first"))).alias("removed"))


def removed_lines(docs: DataFrame, t: float = SIMILARITY) -> DataFrame:
    """(rid, line_no): the removed lines of ``remove_marks``, without counting links."""
    occurrences, classes = occurrences_and_classes(docs)
    pairs, texts, grouped = compared(docs, t)
    later = later_classes(pairs, texts, grouped, firsts_of(classes, texts), t).withColumn("later", F.lit(True))
    known = classes.join(later, "c", "left").select("k1", "k2", "first", "later")
    return occurrences.join(known, ["k1", "k2"]).where(F.col("later").isNotNull() | (place() != F.col("first"))).select("rid", "line_no")


def dedup_lines(docs: DataFrame, t: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` with all columns; text without the removed lines.

    Lines without words stay, null texts stay null, and a document keeps its
    row when all its lines go (empty text). Rows equal in doc_id and text
    are one document: neither repeats the other and both get the same text. A null
    doc_id comes after all others.
    """
    rid, gone = unused(docs, "rid"), unused(docs, "gone")
    marks = removed_lines(docs, t).groupBy(F.col("rid").alias(rid)).agg(F.collect_set("line_no").alias(gone))
    kept = F.filter(F.split(F.col("text"), "\n"), lambda x, i: ~F.array_contains(gone, i))
    rows = docs.withColumn(rid, row_id()).join(marks, rid, "left")
    return rows.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))).select(*docs.columns)
