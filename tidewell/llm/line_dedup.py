"""Line deduplication by a segment-partition edit join (DataFrame operations only).

Two lines are copies if they are equal, or if their edit distance is at most ``errors`` and a tenth of the longer line;
classes are the connected components. Of a class the line that occurs first (least document id, then least line number)
stays, all other lines of the class are removed.

1. Equal lines are reduced to one by 128 bits of hash, in every task before anything is shuffled.
2. Each distinct line is split into ``errors + 1`` segments. If two lines are within ``errors`` edits, one segment of
   the shorter is found unchanged in the longer, at an offset that the segment's number and the difference in length
   bound. So each line is indexed under (length, segment number, segment) and probes, for its own and each shorter
   length in reach, the few substrings that can be such a segment. Keys that one line alone has are dropped.
3. Lines that are left get a signature, the counts of 32 characters modulo 16. A pair that meets under a key is kept
   only if ``errors`` edits can change one signature into the other; this is checked inside the join, so lines that
   share a segment by chance don't multiply.
4. Lines of one template share keys in great number. Under such a crowded key what all its lines begin and end with is
   taken off, which leaves distances as they are. Lines that are equal without one character of the rest each are copies
   and linked to the least of them, not to each other. Only lines that are in different components then meet, under what
   is left without two characters (short rests) or under the segments of the rest.
5. Candidates are verified by the banded bit-parallel recurrence, on what is left of them between their common
   beginning and end: one integer holds the vertical differences of the ``2 * errors + 1`` cells of the band, and moves
   down the diagonal by one bit for each character.
6. Lines of 10 to 19 characters may differ by one edit only, so they are found by equality: with a hole at the same place,
   or without one character.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, released, small
from .components import connected_components

#: Characters whose counts make a line's signature, four bits each, in two numbers.
COUNTED = ("etaonihsrdlucmfw", "0123456789pgybv ")


def lookups(errors: int) -> list[tuple[int, int, int]]:
    """(less, number, shift) of a line's own index entries (the first ``errors + 1``) and then of what it looks for:
    segment ``number`` of a line that is ``less`` characters shorter, moved by ``shift``."""
    own = [(0, i, 0) for i in range(errors + 1)]
    seek = []
    for less in range(errors + 1):
        for i in range(errors + 1):
            low, high = max(-i, less - (errors - i)), min(i, less + (errors - i))
            # of lines of equal length the other one looks for the shifts to the left
            seek += [(less, i, shift) for shift in range(low, high + 1) if less or shift > 0]
    return own + seek


def keyed(lines: DataFrame, errors: int, least: int) -> DataFrame:
    """``d1, d2`` and the keys of ``lookups`` as ``k0..``, null for lines of fewer than ``least`` characters.

    Segment ``i`` of a line of ``n`` characters goes from ``n * i // parts`` to ``n * (i + 1) // parts``; in lines of at
    least ``errors + parts`` characters all that is looked up lies inside. Characters stand in four bytes each here, so
    that a segment is found by its place without a walk over the line.
    """
    parts = errors + 1
    rows = lines.withColumn("b", F.encode("line", "UTF-32")).withColumn("n", (F.octet_length("b") / 4).cast("int"))
    rows = rows.withColumn("n", F.when(F.col("n") >= least, F.col("n")))
    cut = lambda less, i: F.call_function("div", (F.col("n") - less) * i, F.lit(parts)).cast("int")
    rows = rows.withColumns({f"c{less}_{i}": cut(less, i) for less in range(parts) for i in range(parts + 1)})
    made = []
    for k, (less, i, shift) in enumerate(lookups(errors)):
        start, end = F.col(f"c{less}_{i}"), F.col(f"c{less}_{i + 1}")
        segment = F.substring("b", 4 * (start + shift) + 1, 4 * (end - start))
        made.append(F.when(F.col("n").isNotNull(), F.xxhash64(F.col("n") - less, F.lit(i), segment)).alias(f"k{k}"))
    return rows.select("d1", "d2", *made)


def signature(line: Column) -> list[Column]:
    counts = lambda c: (F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))) % 16
    return [reduce(lambda a, b: a + b, [F.shiftleft(counts(c).cast("long"), 4 * k) for k, c in enumerate(part)]) for part in COUNTED]


def may_match(x: str, y: str, errors: int) -> Column:
    """Whether the signatures ``s0, s1`` of two sides allow ``errors`` edits: an edit changes two counts by one at most."""
    apart = []
    for n, part in enumerate(COUNTED):
        for k in range(len(part)):
            at = lambda side: F.shiftright(F.col(f"{side}.s{n}"), 4 * k).bitwiseAND(F.lit(15))
            d = (at(x) - at(y)).bitwiseAND(F.lit(15))
            apart.append(F.least(d, F.lit(16) - d))
    return reduce(lambda p, q: p + q, apart) <= 2 * errors


def within(a: Column, b: Column, errors: int) -> Column:
    """Whether the edit distance of two texts is at most ``errors``; ``a`` is no shorter than ``b``.

    The band's cells of column i are the rows i - errors .. i + errors; bit k stands for row i - errors + k. The
    distance is followed down the band's last diagonal to the last row, then along that row.
    """
    # a one-element transform binds a value, so that it is worked out once wherever the optimizer puts the expression
    bind = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    apart = lambda x, y: F.array_position(F.zip_with(x, y, lambda p, q: ~p.eqNullSafe(q)), True).cast("int")

    def middle(z: Column) -> Column:
        """What lies between the common beginning and the common end; ``same`` if there is no difference."""
        first = apart(z["a"], z["b"])
        return bind(F.struct(first.alias("n"), z["a"].alias("a"), z["b"].alias("b")), lambda t: F.struct(
            (t["n"] == 0).alias("same"),
            F.slice(t["a"], F.greatest(t["n"], F.lit(1)), F.size(t["a"])).alias("a"),
            F.slice(t["b"], F.greatest(t["n"], F.lit(1)), F.size(t["b"])).alias("b"),
        ))

    def cut(z: Column) -> Column:
        last = apart(F.reverse(z["a"]), F.reverse(z["b"]))
        keep = lambda x, n: F.slice(x, 1, F.size(x) - F.greatest(n - 1, F.lit(0)))
        return bind(F.struct(last.alias("n"), z.alias("z")), lambda t: F.struct(
            t["z"]["same"].alias("same"), keep(t["z"]["a"], t["n"]).alias("a"), keep(t["z"]["b"], t["n"]).alias("b")
        ))

    def near(c: Column) -> Column:
        return F.when(F.size(c["a"]) - F.size(c["b"]) <= errors, _within(c["a"], c["b"], errors, bind)).otherwise(False)

    split = F.struct(F.split(a, "").alias("a"), F.split(b, "").alias("b"))
    return bind(split, lambda z: bind(middle(z), lambda m: bind(cut(m), lambda c: c["same"] | near(c))))


def _within(a: Column, b: Column, errors: int, bind) -> Column:
    width = 2 * errors + 1
    full, top = (1 << width) - 1, width - 1
    rows, lit = F.size(a), lambda n: F.lit(n).cast("long")
    state = F.struct(
        lit(full & ~((1 << (width - errors - 1)) - 1)).alias("vp"), lit(0).alias("vn"), F.least(rows, F.lit(errors)).cast("long").alias("d"), F.lit(0).alias("i")
    )

    def step(s: Column, c: Column) -> Column:
        i, vp, vn = s["i"], s["vp"], s["vn"]
        same = reduce(
            lambda x, y: x + y,
            [F.when((i - errors + k >= 0) & (F.get(a, F.greatest(i - errors + k, F.lit(0))) == c), lit(1 << k)).otherwise(lit(0)) for k in range(width)],
        )
        return F.struct(vp.alias("vp"), vn.alias("vn"), s["d"].alias("d"), i.alias("i"), same.alias("x"))

    def turn(t: Column) -> Column:
        x, vp, vn, i = t["x"], t["vp"], t["vn"], t["i"]
        d0 = (x.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(lit(full))
        return F.struct(d0.alias("d0"), vp.alias("vp"), vn.alias("vn"), t["d"].alias("d"), i.alias("i"))

    def flat(t: Column) -> Column:
        d0, vp, vn = t["d0"], t["vp"], t["vn"]
        hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp)).bitwiseAND(lit(full)))
        return F.struct(d0.alias("d0"), hp.alias("hp"), d0.bitwiseAND(vp).alias("hn"), t["d"].alias("d"), t["i"].alias("i"))

    def move(t: Column) -> Column:
        d0, hp, hn, i = t["d0"], t["hp"], t["hn"], t["i"]
        diagonal = i < rows - errors
        bit = F.lit(top - 1) - (i - (rows - errors))  # of the last row, once the band's end has passed it
        at = lambda v: F.call_function("shiftright", F.when(bit >= 0, v).otherwise(lit(0)), F.greatest(bit, F.lit(0))).bitwiseAND(lit(1))
        change = F.when(diagonal, lit(1) - F.shiftright(d0, top).bitwiseAND(lit(1))).otherwise(at(hp) - at(hn))
        half = F.shiftright(d0, 1)
        return F.struct(
            hn.bitwiseOR(F.bitwise_not(half.bitwiseOR(hp)).bitwiseAND(lit(full))).alias("vp"),
            half.bitwiseAND(hp).alias("vn"),
            (t["d"] + change).alias("d"),
            (i + 1).alias("i"),
        )

    # down the diagonal the distance never falls, and along the last row by twice the errors at most, so a pair that
    # is too far apart stops there
    last = F.aggregate(b, state, lambda s, c: F.when(s["d"] > 3 * errors, s).otherwise(bind(bind(bind(step(s, c), turn), flat), move)))
    return last["d"] <= errors


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each line that isn't blank, with its document's and its own hashes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(id_col, text).alias("k1"), F.xxhash64(F.lit(5), text, F.col(id_col)).alias("k2"), text.alias("t")
    )
    lines = keyed.select("id", "k1", "k2", F.posexplode(F.split("t", "\n", -1)).alias("line_no", "line")).where("trim(line) != ''")
    return lines.select("*", F.xxhash64("line").alias("d1"), F.xxhash64(F.lit(7), "line").alias("d2"))


#: Lines under one key that may all meet; beyond that they are of one template, most likely.
CROWDED = 32
#: Rests of templates up to which one and two characters are left out of them.
LONGEST_ONE, LONGEST_TWO = 64, 12
#: Characters for each edit.
SHARE = 10


def _pairs(candidates: DataFrame, found: DataFrame, errors: int, tasks: int) -> DataFrame:
    """Those of the candidates (``a, b``) that are copies."""
    side = lambda p: small(found.select(F.col("id").alias(p), F.col("line").alias(f"{p}_line")))
    size = lambda p: F.char_length(f"{p}_line")
    fits = (F.abs(size("a") - size("b")) <= errors) & (F.greatest(size("a"), size("b")) >= errors * SHARE)
    pairs = candidates.join(side("a"), "a").join(side("b"), "b").where(fits)
    # few bytes, much work: spread over all tasks (without the checkpoint the filter would be moved below the exchange)
    pairs = durable(pairs.repartition(tasks, "a", "b"))
    swap = size("a") < size("b")
    longer = F.when(swap, F.col("b_line")).otherwise(F.col("a_line"))
    shorter = F.when(swap, F.col("a_line")).otherwise(F.col("b_line"))
    return durable(pairs.where(within(longer, shorter, errors)).select("a", "b"))


def similar_lines(distinct: DataFrame, lines: DataFrame, errors: int, least: int) -> DataFrame:
    """``a, b``: ids (structs of both hashes) of distinct lines of at least ``least`` characters that are copies; not all
    pairs, but all that components need.

    ``distinct`` has ``d1, d2, k0..`` (see ``_distinct``) and is read several times.
    """
    n_own, n_all = errors + 1, len(lookups(errors))
    of = lambda low, high: F.explode(F.array(*[F.col(f"k{k}") for k in range(low, high)]))
    rows = distinct.select("d1", F.col("k0").isNotNull().alias("long"), *[f"k{k}" for k in range(n_all)]).where("long")
    every = rows.select("d1", of(0, n_all).alias("key")).where("key IS NOT NULL")
    shared = every.groupBy("key").agg(F.min("d1").alias("low"), F.max("d1").alias("high"), F.count(F.lit(1)).alias("size")).where("low != high")
    shared = small(durable(shared.select("key", (F.col("size") > CROWDED).alias("crowded"))))
    own = rows.select("d1", of(0, n_own).alias("key")).withColumn("own", F.lit(True))
    seek = rows.select("d1", of(n_own, n_all).alias("key")).where("key IS NOT NULL").withColumn("own", F.lit(False))
    met = durable(own.union(seek).join(shared, "key").select("key", "d1", "own", "crowded"))
    wanted = small(durable(met.select("d1").distinct()))
    text = lines.where(F.char_length("line") >= least).join(wanted, "d1").groupBy("d1", "d2").agg(F.first("line").alias("line"))
    found = durable(text.select(F.struct("d1", "d2").alias("id"), "line", *[c.alias(f"s{k}") for k, c in enumerate(signature(F.col("line")))]))
    signed = found.select(F.col("id.d1").alias("d1"), "id", "s0", "s1")
    placed = met.where("NOT crowded").join(small(signed), "d1")
    own = placed.where("own").select("key", "id", "s0", "s1")

    def meet(left: DataFrame, ordered: bool) -> DataFrame:
        x, y = F.col("x.id"), F.col("y.id")
        kept = (F.col("x.key") == F.col("y.key")) & ((x < y) if ordered else (x != y)) & may_match("x", "y", errors)
        return left.alias("x").join(own.alias("y"), kept).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))

    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    candidates = durable(meet(own, True).union(meet(placed.where("NOT own"), False)).distinct())
    links = _pairs(candidates, found, errors, tasks)
    crowded = durable(met.where("crowded").select("key", "d1").distinct())
    return links if crowded.isEmpty() else links.union(template_links(crowded, found, errors, tasks))


def _leading(a: Column, b: Column) -> Column:
    """How many characters two texts begin with alike."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda p, q: p.eqNullSafe(q) & (p != ""))
    return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same)).cast("int")


def _without(text: Column, k: Column) -> Column:
    """A text without its character ``k`` (from 1)."""
    return F.concat(F.substr(text, F.lit(1), k - 1), F.substr(text, k + 1))


def _marks(value: Column) -> Column:
    """128 bits of a piece of a rest, under its template."""
    return F.struct(F.xxhash64("group", value).alias("v1"), F.xxhash64(F.lit(11), value, F.col("group")).alias("v2"))


def template_links(crowded: DataFrame, found: DataFrame, errors: int, tasks: int) -> DataFrame:
    """Links among the lines (``found``) that share a crowded key (``key, d1``); for up to two errors."""
    rows = crowded.join(small(found.select(F.col("id.d1").alias("d1"), "id", "line", "s0", "s1")), "d1").select("key", "id", "line", "s0", "s1")
    back = F.reverse("line")
    ends = rows.groupBy("key").agg(F.min("line").alias("l0"), F.max("line").alias("l1"), F.min(back).alias("r0"), F.max(back).alias("r1"), F.min(F.char_length("line")).alias("short"))
    ends = ends.withColumn("p", _leading(F.col("l0"), F.col("l1"))).withColumn("q", F.least(_leading(F.col("r0"), F.col("r1")), F.col("short") - F.col("p")))
    # keys whose lines begin and end alike have one group
    group = F.struct(F.substr("l0", F.lit(1), F.col("p")).alias("begin"), F.substr("r0", F.lit(1), F.col("q")).alias("end"))
    ends = ends.select("key", "p", "q", F.concat(F.xxhash64(group).cast("string"), F.lit(":"), F.xxhash64(F.lit(3), group).cast("string")).alias("group"))
    middle = F.substr("line", F.col("p") + 1, F.char_length("line") - F.col("p") - F.col("q"))
    rests = durable(rows.join(small(durable(ends)), "key").select("group", "id", "s0", "s1", F.char_length("line").alias("n"), middle.alias("rest")).distinct())
    r = F.col("rest")
    ones = lambda x: F.when(F.char_length(x) > 0, F.transform(F.sequence(F.lit(1), F.char_length(x)), lambda k: _without(x, k))).otherwise(F.array().cast("array<string>"))
    links = None
    if errors == 2:
        brief = rests.where((F.char_length(r) <= LONGEST_ONE) & (F.col("n") >= errors * SHARE))
        cut = brief.select("group", "id", F.explode(F.array_distinct(F.array_append(ones(r), r))).alias("piece")).select("id", _marks(F.col("piece")).alias("v"))
        first = cut.groupBy("v").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a != z").select("v", "a")
        links = durable(cut.join(first, "v").where("id != a").select("a", F.col("id").alias("b")).distinct())
        roots = durable(connected_components(links))
        rests = rests.join(small(roots.withColumnRenamed("node", "id")), "id", "left").withColumn("root", F.coalesce("root", "id"))
    else:
        rests = rests.withColumn("root", F.col("id"))
    tiny = rests.where(F.char_length(r) <= LONGEST_TWO + errors)  # some are in both, for their lengths may differ
    less = F.array_append(ones(r), r)
    if errors > 1:
        less = F.concat(less, F.flatten(F.transform(ones(r), ones)))
    left_out = tiny.select("group", "id", "root", "s0", "s1", F.explode(F.array_distinct(less)).alias("piece")).select("id", "root", "s0", "s1", _marks(F.col("piece")).alias("v"))
    long = keyed(rests.where(F.char_length(r) > LONGEST_TWO).select(F.struct("group", "id", "root", "s0", "s1").alias("d1"), F.lit(0).alias("d2"), F.col("rest").alias("line")), errors, 1)
    keys = F.array_distinct(F.array(*[F.col(f"k{k}") for k in range(len(lookups(errors)))]))
    segments = long.select("d1.*", F.explode(keys).alias("piece")).select("id", "root", "s0", "s1", _marks(F.col("piece")).alias("v"))
    pieces = left_out.union(segments)  # many and quickly made, so made twice and not kept
    several = pieces.groupBy("v").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("v")
    open_ = durable(pieces.join(small(durable(several)), "v"))
    apart = (F.col("x.v") == F.col("y.v")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.root") != F.col("y.root")) & may_match("x", "y", errors)
    candidates = durable(open_.alias("x").join(open_.alias("y"), apart).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct())
    more = _pairs(candidates, found, errors, tasks)
    return more if links is None else links.union(more)


def short_links(lines: DataFrame, low: int, high: int) -> DataFrame:
    """``a, b``: distinct lines of ``low`` to ``high`` characters at one edit, the longer over ``low``; those that a hole
    makes equal are linked to the least of them."""
    size = F.char_length("line")
    rows = durable(lines.where(size.between(low, high)).select(F.struct("d1", "d2").alias("id"), "line").distinct())
    hashed = lambda n, *v: F.struct(F.xxhash64(F.lit(n), *v).alias("v1"), F.xxhash64(*v, F.lit(n + 1)).alias("v2"))
    places = rows.select("id", "line", F.explode(F.sequence(F.lit(1), size)).alias("k"))
    pieces = places.where(size > low).select("id", "k", _without(F.col("line"), F.col("k")).alias("piece"))
    holed = pieces.select("id", hashed(1, F.col("k"), F.col("piece")).alias("v"))
    first = holed.groupBy("v").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a != z").select("v", "a")
    replaced = holed.join(small(durable(first)), "v").where("id != a").select("a", F.col("id").alias("b"))
    whole = rows.select(F.col("id").alias("a"), F.xxhash64("line").alias("h"), "line")
    added = pieces.select(F.col("id").alias("b"), "piece", F.xxhash64("piece").alias("h")).join(whole, "h").where("piece = line").select("a", "b")
    return durable(replaced).union(durable(added))


def _distinct(lines: DataFrame, errors: int, least: int) -> DataFrame:
    """``d1, d2, n, k0..``: how often each line occurs, and its keys.

    Keys are numbers in columns of their own, so that rows are reduced by a hash map.
    """
    listed = [f"k{k}" for k in range(len(lookups(errors)))]
    return keyed(lines, errors, least).groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"), *[F.max(k).alias(k) for k in listed])


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", errors: int = 2) -> DataFrame:
    """``k1, k2, removed``: for each document with lines to remove, an array of (line_no, first_id, first_line).

    ``k1, k2`` are the document's hashes, ``first_id`` and ``first_line`` tell where the class occurs first.
    """
    if not 1 <= errors <= 2:
        raise ValueError("one or two errors")
    lines = _lines(docs, id_col, text_col)
    least = SHARE * errors - errors  # the shorter of two lines, the longer of which may have all edits
    distinct = durable(_distinct(lines, errors, least))
    links = similar_lines(distinct, lines, errors, least)
    if errors == 2:
        links = links.union(short_links(lines, SHARE - 1, 2 * SHARE - 1))
    links = durable(links)
    released(docs.sparkSession)
    roots = durable(connected_components(links))
    of_node = roots.select(F.col("node.d1").alias("d1"), F.col("node.d2").alias("d2"), "root")
    classes = distinct.select("d1", "d2", "n").join(small(of_node), ["d1", "d2"], "left").where("n > 1 OR root IS NOT NULL")
    classes = durable(classes.select("d1", "d2", F.coalesce("root", F.struct("d1", "d2")).alias("root")))
    met = durable(lines.select("d1", "d2", "id", "k1", "k2", "line_no").join(small(classes), ["d1", "d2"]).drop("d1", "d2"))
    first = small(durable(met.groupBy("root").agg(F.min(F.struct("id", "k1", "line_no")).alias("first"))))
    gone = met.join(first, "root").where(~((F.col("first.k1") == F.col("k1")) & (F.col("first.line_no") == F.col("line_no"))))
    each = F.struct("line_no", F.col("first.id").alias("first_id"), F.col("first.line_no").alias("first_line"))
    return gone.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(each)).alias("removed"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", errors: int = 2) -> DataFrame:
    """``docs`` with repeated lines removed from ``text_col``, and ``n_lines, removed`` added (see ``repeated_lines``).

    Every row stays, also one that loses all its lines; its text is then empty. Blank lines are never removed. A null
    text counts as empty, and becomes so. Rows that repeat both id and text count as one document and all keep the same
    lines. A null id comes before all others. Columns of the two names are replaced; others pass through. An empty
    table stays empty.
    """
    removed = small(durable(repeated_lines(docs, id_col, text_col, errors)))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.drop("n_lines", "removed").withColumns({"__line_k1": F.xxhash64(id_col, text), "__line_k2": F.xxhash64(F.lit(5), text, F.col(id_col))})
    joined = rows.join(removed.withColumnsRenamed({"k1": "__line_k1", "k2": "__line_k2"}), ["__line_k1", "__line_k2"], "left")
    lines = F.split(text, "\n", -1)
    left = F.filter(lines, lambda _, k: ~F.array_contains("removed.line_no", k))
    return (
        joined.withColumn("n_lines", F.size(lines).cast("long"))
        .withColumn(text_col, F.when(F.col("removed").isNull(), text).otherwise(F.array_join(left, "\n")))
        .withColumn("removed", F.coalesce("removed", F.array().cast(removed.schema["removed"].dataType)))
        .drop("__line_k1", "__line_k2")
    )
