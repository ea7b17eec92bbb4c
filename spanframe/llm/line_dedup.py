"""Line dedup by a deletion-neighbourhood join, with DataFrame operations only.

Two lines within one edit (one character inserted, deleted or replaced) share a variant: the line itself, or the line
without one of its characters. All variants are emitted as hashed keys and equal variants meet:

- lines that share a variant by deleting at the same place differ by one replaced character, or are one edit apart;
- a line that is itself the variant of another differs from it by one inserted character.

So a variant's lines need no pairs: each is held against the earliest of its place, and against the undeleted line.
Those links are verified on the texts (both must give the variant), and a line goes if an earlier one is within the bound, or is its copy.

Two steps keep the emission small and lose nothing. Copies of a line are one line. And of two lines within an edit, either
the first half (of the shorter's length) or the rest is equal in both: only lines that share such a half with another
line emit variants, with deletions in the other half. A variant's key is the exclusive or of hashes of (character, place),
which running windows give for all deletions of a line in linear time, however long it is.

Lines that stand very often meet what is known of them by a broadcast of those few (join_heavy); all else is joined by shuffles, or as
Spark sees fit by the tables' bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._base import join_heavy, split_repeats, stored


def _hashes(*columns: Column | str) -> list[Column]:
    """96 bits in two columns."""
    return [F.xxhash64(*columns).alias("h"), F.hash(*columns).alias("g")]


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.posexplode(F.split(text_col, "\n")).alias("no", "line"))
    return rows.select("id", "mark", "no", "line", *_hashes("line"))


def _half_keys(line: Column) -> Column:
    """Keys of the halves: as the shorter (or equal) line of a pair, and as the longer by one. Even places hold first halves."""
    n = F.length(line)
    out = []
    for short in (n, n - 1):
        half = F.floor(short / 2).cast("int")
        out.append(F.xxhash64(F.lit("first"), short, F.substring(line, F.lit(1), half)))
        out.append(F.xxhash64(F.lit("rest"), short, F.substring(line, half + (n - short) + 1, n)))
    return F.array(*out)


def _variants(lines: DataFrame) -> DataFrame:
    """lines(h, g, first, line, low, high) -> (v, w, at, first): the line itself (at 0), and deletions at low..high."""
    chars = lines.repartition("h", "g").select("h", "g", "first", "low", "high", F.posexplode(F.concat(F.array(F.lit("")), F.regexp_extract_all("line", F.lit("(?s)."), F.lit(0)))).alias("at", "c"))
    by = Window.partitionBy("h", "g")
    upto = by.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    real = F.col("at") > 0
    keys = []
    for name, seed in (("v", 1), ("w", 2)):
        for shift in (0, 1):
            hashed = F.xxhash64(F.lit(seed), "c", F.col("at") - shift)
            chars = chars.withColumn(f"{name}{shift}", F.when(real, hashed).otherwise(F.lit(0).cast("bigint")))
    for name in ("v", "w"):
        chars = chars.withColumn(f"{name}_upto", F.bit_xor(f"{name}0").over(upto)).withColumn(f"{name}_shifted", F.bit_xor(f"{name}1").over(upto))
        chars = chars.withColumn(f"{name}_all", F.bit_xor(f"{name}0").over(by)).withColumn(f"{name}_all1", F.bit_xor(f"{name}1").over(by))
        before = F.col(f"{name}_upto").bitwiseXOR(F.col(f"{name}0"))
        after = F.col(f"{name}_all1").bitwiseXOR(F.col(f"{name}_shifted"))
        keys.append(F.when(real, before.bitwiseXOR(after)).otherwise(F.col(f"{name}_all")))
    chars = chars.where(~real | F.col("at").between(F.col("low"), F.col("high")))
    return chars.select(keys[0].alias("v"), keys[1].bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("w"), "at", "first")


def _near(texts: DataFrame) -> DataFrame:
    """texts(h, g, first, line, low, high) -> (h, g) of the lines that are one edit away from an earlier one."""
    variants = _variants(texts).repartition("v", "w")
    same, own = Window.partitionBy("v", "w", "at"), Window.partitionBy("v", "w")
    deleted, who = F.col("at") > 0, F.struct("first", "at")
    variants = variants.withColumn("whole", F.min(F.when(~deleted, who)).over(own)).withColumn("cut", F.min(F.when(deleted, who)).over(own)).withColumn("in_place", F.min(who).over(same))
    earlier = F.explode(F.array(F.when(deleted, F.col("in_place")), F.when(deleted, F.col("whole")), F.when(~deleted, F.col("cut")))).alias("e")
    links = variants.select("first", "at", earlier).where("e is not null and e.first < first")
    links = links.groupBy("first", F.col("e.first").alias("e")).agg(F.min(F.struct(F.col("at").alias("mine"), F.col("e.at").alias("other"))).alias("cuts"))
    other = texts.select(F.col("first").alias("e"), F.col("line").alias("line2"))
    pairs = links.join(texts.select("first", "h", "g", "line"), "first").join(other, "e")
    # an edit distance of at most one, proved by the shared variant; unlike a matrix of distances, in linear time
    return pairs.where(_without("line", "cuts.mine") == _without("line2", "cuts.other")).select("h", "g").distinct()


def _without(line: str, at: str) -> Column:
    """The line without its character at a place from 1; the line itself for 0."""
    rest = F.concat(F.substring(line, F.lit(1), F.col(at) - 1), F.substring(line, F.col(at) + 1, F.length(line)))
    return F.when(F.col(at) > 0, rest).otherwise(F.col(line))


def repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, no): the lines to remove; mark tells rows of one id with other texts apart, no counts from 0."""
    lines = _lines(docs, id_col, text_col)
    blank = _blank(F.col("line"))
    found = stored(lines.where(~blank).select("id", "mark", "no", "h", "g", F.length("line").alias("size"), _half_keys(F.col("line")).alias("halves")), "lines")
    place = F.struct("id", "mark", "no")
    halves = found.select("h", "g", "size", F.posexplode("halves").alias("role", "key"))
    ends = halves.groupBy("key").agg(F.min("h").alias("h0"), F.max("h").alias("h1"), F.min("g").alias("g0"), F.max("g").alias("g1"), F.count("*").alias("n"))
    shared = stored(ends.where("h0 <> h1 or g0 <> g1").select("key", "n"), "halves")
    longer = F.when(F.col("role") >= 2, 1).otherwise(0)
    half, is_first = F.floor((F.col("size") - longer) / 2).cast("int"), F.col("role") % 2 == 0
    low, high = F.when(is_first, half + 1).otherwise(1), F.when(is_first, F.col("size")).otherwise(half + longer)
    likely = join_heavy(halves, shared, ["key"], "n").groupBy("h", "g").agg(F.min(low).alias("low"), F.max(high).alias("high"))
    firsts = found.groupBy("h", "g").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    firsts = stored(firsts.join(likely, ["h", "g"], "left").where("n > 1 or low is not null"), "firsts")
    mine = firsts.where("low is not null").select(F.col("first.id").alias("id1"), F.col("first.mark").alias("mark1"), F.col("first.no").alias("no1"), F.struct("h", "g", "first", "low", "high").alias("mine"))
    at_first = F.col("id").eqNullSafe(F.col("id1")) & (F.col("mark") == F.col("mark1")) & (F.col("no") == F.col("no1"))
    texts = lines.select("id", "mark", "no", "line").join(mine, at_first).select("mine.*", "line").dropDuplicates(["h", "g"])
    near = _near(stored(texts, "texts")).withColumn("near", F.lit(True))
    repeats = stored(firsts.join(near, ["h", "g"], "left").where("n > 1 or near").select("h", "g", "first", "near", "n"), "repeats")
    return join_heavy(found.select("id", "mark", "no", "h", "g"), repeats, ["h", "g"], "n").where(F.col("near") | (F.col("first") != place)).select("id", "mark", "no")


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Every document without the lines that an earlier line copies or that are one edit away from an earlier line.

    Earlier is by id, then by place. Returns a row for each row of docs: <id_col>, the columns in keep, n_lines, n_removed,
    text (the kept lines; null for null). Lines end at a line feed. Blank lines stay. A line is held against all earlier
    distinct lines, whether or not those stay. Null ids come first. Rows of one id and different texts are in the order of their
    texts' hashes; of rows of one id and text (or of no id and one text) all but one lose every line that is not blank. Other columns
    are not read.
    """
    columns = list(dict.fromkeys((id_col, *keep, text_col)))
    names = [f"__c{i}" for i in range(len(columns))]
    own = dict(zip(columns, names, strict=True))
    once, more = split_repeats(docs.select(*(F.col(c).alias(n) for c, n in own.items())), own[id_col], own[text_col])
    out = _without_repeats(once, own[id_col], own[text_col], [own[c] for c in keep])
    if more is not None:
        lines = F.split(own[text_col], "\n")
        blank = F.filter(lines, lambda x: _blank(x))
        rest = [F.size(lines).cast("bigint").alias("n_lines"), (F.size(lines) - F.size(blank)).cast("bigint").alias("n_removed"), F.array_join(blank, "\n").alias("text")]
        out = out.union(more.select(F.col(own[id_col]), *(F.col(own[c]) for c in keep), *rest))
    return out.toDF(id_col, *keep, "n_lines", "n_removed", "text")


def _blank(line: Column) -> Column:
    return F.trim(F.translate(line, "\t\r\x0b\x0c", "    ")) == ""


def _without_repeats(docs: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """(id, keep, n_lines, n_removed, text) of rows that differ in id or text."""
    gone = repeated_lines(docs, id_col=id_col, text_col=text_col).groupBy("id", "mark").agg(F.collect_set("no").alias("gone"))
    gone = gone.select(F.col("id").alias("__id2"), F.col("mark").alias("__mark2"), "gone")
    rows = docs.select(F.col(id_col).alias("__id"), *(F.col(c).alias(f"__{i}") for i, c in enumerate(keep)), F.col(text_col).alias("__text"), F.xxhash64(text_col).alias("__mark"))
    out = rows.join(gone, F.col("__id").eqNullSafe(F.col("__id2")) & (F.col("__mark") == F.col("__mark2")), "left")
    lines = F.col("__lines")  # a column of its own, so that no element splits the text again
    out = out.withColumn("__lines", F.split("__text", "\n"))
    n = F.when(F.col("__text").isNull(), 0).otherwise(F.size(lines)).cast("bigint")
    n_removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("bigint")
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    left = F.when(F.col("gone").isNull(), F.col("__text")).otherwise(F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n"))
    return out.select("__id", *(F.col(f"__{i}") for i in range(len(keep))), n.alias("n_lines"), n_removed.alias("n_removed"), left.alias("text"))
