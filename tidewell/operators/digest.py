"""What is kept of a session: extracts, focus views, digests; and the order of what is read."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import markdown, text
from tidewell.plans.lineage import durable

#: Lines of an extract, error lines of a command, characters of a digest part, of an argument and of a command. Fixed values.
EXTRACT_LINES, ERROR_LINES, PART_CHARS, ARG_CHARS = 400, 20, 60_000, 160
GAP = "[...]"


def error_lines(output: Column, most: int = ERROR_LINES) -> Column:
    """The lines that name the problem, and an indented one right after such a line."""
    lines = F.filter(F.split(output, r"\r?\n", -1), lambda x: (F.trim(x) != "") & ~x.startswith("Exit code "))
    key = text.key_lines(output)
    near = F.transform(
        lines,
        lambda x, k: F.struct(
            text.trimmed(x).alias("line"),
            (F.array_contains(key, text.trimmed(x)) | ((k > 0) & x.rlike(r"^[ \t]") & F.array_contains(key, text.trimmed(F.get(lines, F.greatest(k - 1, F.lit(0))))))).alias("kept"),
        ),
    )
    return F.slice(F.transform(F.filter(near, lambda s: s["kept"]), lambda s: s["line"]), 1, most)


def labelled(label: Column, body: Column) -> Column:
    """The lines of a text, the first after its label, the others set in; none if it is empty."""
    lines = F.split(text.trimmed(body), r"\r?\n", -1)
    return F.when(
        text.trimmed(body) != "",
        F.transform(lines, lambda x, k: F.when(k == 0, F.concat(F.lit("["), label, F.lit("] "), x)).otherwise(F.concat(F.lit("  "), x))),
    ).otherwise(F.array().cast("array<string>"))


def _failed_label(output: Column) -> Column:
    code = F.regexp_extract(output, r"^Exit code ([^\n]*)", 1)
    return F.when(code != "", F.concat(F.lit("command failed, exit "), F.trim(code))).otherwise("command failed")


def recovered(steps: DataFrame) -> DataFrame:
    """``steps`` with ``first_ok``: a command that works, of a program that failed since it last worked."""
    ran = F.when(F.col("kind") == "command", text.program(F.col("command")))
    w = Window.partitionBy("session", "__program").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    marked = steps.withColumn("__program", ran)
    before = F.last(F.when(F.col("kind") == "command", F.col("ok")), ignorenulls=True).over(w)
    worked = (F.col("kind") == "command") & F.col("ok") & F.col("__program").isNotNull() & F.coalesce(~before, F.lit(False))
    return marked.withColumn("first_ok", F.coalesce(worked, F.lit(False))).drop("__program")


def entries(steps: DataFrame, digest: bool = False) -> DataFrame:
    """``session, step, lines``: what each step leaves in an extract (prompts, text, failures with their error lines and
    the command that then worked), or in a ``digest`` (times and one line for each call as well, texts cut)."""
    rows = recovered(steps)
    kind, failed = F.col("kind"), (F.col("kind") == "command") & ~F.coalesce("ok", F.lit(True))
    command = F.substring("command", 1, 4 * ARG_CHARS) if digest else F.col("command")
    output = F.coalesce("output", F.lit(""))
    errors = F.transform(error_lines(output), lambda x: F.concat(F.lit("  "), x))
    failure = F.concat(labelled(_failed_label(output), command), F.array(F.lit("[tool output]")), errors)
    call = lambda name, arg: F.array(F.concat(F.lit("[tool] "), name, F.lit(": "), F.substring(F.substring_index(F.coalesce(arg, F.lit("")), "\n", 1), 1, ARG_CHARS)))
    prompt = labelled(F.lit("user"), markdown.without_reminders(F.col("text")))
    lines = F.when(kind == "prompt", prompt).when(kind == "text", labelled(F.lit("agent"), F.col("text"))).when(failed, failure)
    if digest:
        lines = lines.when(kind == "time", F.array(F.concat(F.lit("["), "text", F.lit("]")))).when(kind == "command", call(F.lit("bash"), F.col("command")))
        lines = lines.when(kind == "tool", call(F.coalesce("name", F.lit("")), F.col("text")))
    else:
        lines = lines.when(F.col("first_ok"), labelled(F.lit("command worked"), F.col("command")))
    return rows.select("session", "step", lines.alias("lines")).where("size(lines) > 0")


def extracts(steps: DataFrame, most: int = EXTRACT_LINES) -> DataFrame:
    """``session, line_no, line``: the extract of each session, runs of equal set-in lines as one with their number, the
    last ``most`` lines with a note of how many were cut."""
    lines = entries(steps).select("session", "step", F.posexplode("lines").alias("k", "line"))
    w = Window.partitionBy("session").orderBy("step", "k")
    new = F.lag("line").over(w).isNull() | (F.lag("line").over(w) != F.col("line")) | ~F.col("line").startswith("  ")
    runs = lines.withColumn("run", F.sum(new.cast("int")).over(w)).groupBy("session", "run").agg(F.first("line").alias("line"), F.count(F.lit(1)).alias("n"))
    shown = F.when(F.col("n") > 1, F.concat("line", F.lit(" (×"), F.col("n").cast("string"), F.lit(")"))).otherwise(F.col("line"))
    total = F.count(F.lit(1)).over(Window.partitionBy("session"))
    placed = runs.select("session", F.row_number().over(Window.partitionBy("session").orderBy("run")).alias("place"), shown.alias("line"), total.alias("total"))
    cut = F.when(F.col("total") > most, F.col("total") - (most - 1)).otherwise(0)
    kept = placed.withColumn("cut", cut).where(F.col("place") > F.col("cut"))
    body = kept.select("session", (F.col("place") - F.col("cut") + (F.col("cut") > 0).cast("int")).cast("int").alias("line_no"), "line")
    notes = kept.where("cut > 0").groupBy("session").agg(F.max("cut").alias("cut"))
    return body.union(notes.select("session", F.lit(1), F.concat(F.lit("["), F.col("cut").cast("string"), F.lit(" earlier lines cut]"))))


def changed_times(steps: DataFrame) -> DataFrame:
    """The steps, with time steps only where the time differs from the one before."""
    w = Window.partitionBy("session").orderBy("step")
    last = F.last(F.when(F.col("kind") == "time", F.col("text")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return steps.withColumn("__last", last).where("kind != 'time' OR __last IS NULL OR __last != text").drop("__last")


def digest_parts(lines: DataFrame) -> DataFrame:
    """``session, step, part, text``: entries (``session, step, lines``) cut to fit a part and dealt to parts in order; an
    entry that would pass a part's characters begins the next. Steps of a session are distinct.

    Running sums say for each entry where the part ends that would begin with it, so an entry points to the next part's
    first. Which entries do begin a part is found from the first one by doubling: each round knows all that are reached
    in twice as many steps, and where twice as many steps lead.
    """
    cut = lines.select("session", "step", F.substring(F.array_join("lines", "\n"), 1, PART_CHARS - 1).alias("text"))
    order = Window.partitionBy("session").orderBy("step")
    size = F.char_length("text") + 1  # with the line end before the next
    upto = F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = durable(cut.select("session", "step", (F.row_number().over(order) - 1).alias("k"), size.alias("size"), upto.alias("upto")))
    # an entry's part takes all entries up to a sum; the last such entry is found by sorting sums and limits together
    sums = placed.select("session", F.col("upto").alias("v"), F.lit(0).alias("limit"), "k")
    limits = placed.select("session", F.col("upto") - F.col("size") + PART_CHARS + 1, F.lit(1), "k")
    rising = Window.partitionBy("session").orderBy("v", "limit").rowsBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(F.col("limit") == 0, F.col("k"))).over(rising)
    jumps = sums.union(limits).withColumn("to", last + 1).where("limit = 1").select("session", "k", "to")
    jumps = durable(jumps.join(placed.select("session", F.col("k").alias("to")), ["session", "to"], "left_semi").select("session", "k", "to"))
    begun = durable(placed.where("k = 0").select("session", "k"))
    while not jumps.isEmpty():
        more = begun.join(jumps, ["session", "k"]).select("session", F.col("to").alias("k"))
        begun = durable(begun.union(more).distinct())
        onward = jumps.select("session", F.col("k").alias("to"), F.col("to").alias("further"))
        jumps = durable(jumps.join(onward, ["session", "to"]).select("session", "k", F.col("further").alias("to")))
    starts = placed.join(begun.withColumn("begins", F.lit(1)), ["session", "k"], "left")
    part = F.sum(F.coalesce("begins", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1
    return cut.join(starts.select("session", "step", part.cast("int").alias("part")), ["session", "step"]).select("session", "step", "part", "text")


#: Items that a worker chooses from at once.
CHOSEN = 1 << 17


def _choosing(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The items that stay if those of the partition (or of a part of it that is small enough) were all."""

    def kept(rows: pa.Table) -> pa.Table:
        place, item, signatures = (rows[c].to_pylist() for c in ("place", "item", "signatures"))
        seen, at = set(), []
        for k in sorted(range(len(item)), key=lambda k: (place[k] is None, place[k], item[k])):
            new = next((s for s in signatures[k] if s not in seen), None)
            if new is not None:
                seen.add(new)
                at.append(k)
        return rows.take(pa.array(at, pa.int64()))

    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        if held.num_rows > CHOSEN:
            held = kept(held)
            if held.num_rows > CHOSEN // 2:  # begun anew, which keeps more items than needed
                yield from held.to_batches()
                held = None
    if held is not None:
        yield from kept(held).to_batches()


def representatives(items: DataFrame) -> DataFrame:
    """``item``: of items in order (``item, place, signatures``), those with a signature that none kept before has, or
    without any. A kept item's signatures count up to its first new one. Items are distinct.

    Each choice depends on those before it. But an item that finds no new signature among some of the items finds none
    among all, so each partition drops such items first; as many as there are signatures are left of it at most. What
    is left is settled in one task if it is little. Else items ask for their signatures in turn: of those that ask for
    the same the first holds it, and the others ask for their next, until nobody moves. Each round is checkpointed.
    """
    rows = items.where(F.size("signatures") > 0).select("item", "place", "signatures")
    alone = items.where(F.size("signatures") == 0).select("item")
    left = durable(rows.mapInArrow(_choosing, rows.schema))
    if left.count() <= CHOSEN:
        return alone.union(left.coalesce(1).mapInArrow(_choosing, rows.schema).select("item"))
    asked = F.get("signatures", F.col("k"))
    pool = durable(left.withColumn("k", F.lit(0)).where(asked.isNotNull()))
    while True:
        before = F.struct(F.col("place").isNull(), "place", "item")
        first = pool.groupBy(asked.alias("sig")).agg(F.min_by("item", before).alias("item")).select("item", F.lit(True).alias("first"))
        moved = durable(pool.join(first, "item", "left").withColumn("k", F.when(F.col("first"), F.col("k")).otherwise(F.col("k") + 1)))
        if moved.where("first IS NULL").isEmpty():
            return alone.union(pool.select("item"))
        pool = moved.where(asked.isNotNull()).drop("first")


#: How a line begins that tells of a command, and the one after which its output stands set in. Fixed values.
MARKS, OUTPUT = ("[command failed", "[command worked]", "[tool output]"), "[tool output]"


def focus_views(items: DataFrame, most: int, around: int = 2, around_match: int = 5) -> DataFrame:
    """``id, view``: of each item (``id, body``, and ``at``, the number of a line, if there is such a column) what matters
    most, in at most ``most`` lines: lines near ``at``, then those near commands and their output, the last ones first;
    without any of these the end. Gaps are marked and count as lines. Items that fit are whole.

    Lines are ranked, and a window adds up what each costs after those before it: itself and a gap, less one gap for
    each neighbour that is there already. Ids are distinct.
    """
    rows = items if "at" in items.columns else items.withColumn("at", F.lit(None).cast("int"))
    body = F.regexp_replace(F.coalesce("body", F.lit("")), r"\n\z", "")
    lines = rows.select("id", "at", F.posexplode(F.split(body, "\n", -1)).alias("k", "line"))
    item, down = Window.partitionBy("id"), Window.partitionBy("id").orderBy("k")
    mark = F.greatest(*[F.col("line").startswith(m) for m in MARKS])
    set_in = F.col("line").startswith("  ")
    owner = F.last(F.when(~set_in, F.col("line")), ignorenulls=True).over(down)
    core = mark | (set_in & F.coalesce(owner.startswith(OUTPUT), F.lit(False)))
    near = F.max("core").over(down.rowsBetween(-around, around))
    asked = F.col("at").between(1, F.col("n")) & (F.abs(F.col("k") + 1 - F.col("at")) <= around_match)
    seen = lines.withColumn("n", F.count(F.lit(1)).over(item)).withColumn("core", core).withColumn("near", near).withColumn("asked", F.coalesce(asked, F.lit(False)))
    chosen = F.when(F.max("near").over(item), F.col("near")).otherwise(F.col("k") >= F.col("n") - most)
    listed = seen.withColumn("chosen", chosen).where("n > " + str(int(most)) + " AND (chosen OR asked)")
    ranked = listed.withColumn("rank", F.row_number().over(item.orderBy(F.desc("asked"), F.desc("k"))))
    beside = lambda step: F.coalesce((F.max(F.struct("k", "rank")).over(down.rowsBetween(step, step))), F.struct(F.lit(-9).alias("k"), F.lit(0).alias("rank")))
    joined = lambda step: ((beside(step)["k"] == F.col("k") + step) & (beside(step)["rank"] < F.col("rank"))).cast("int")
    costs = ranked.withColumn("cost", 2 - joined(-1) - joined(1))
    by_rank = item.orderBy("rank")
    total = costs.withColumn("total", F.sum("cost").over(by_rank) - 1)
    kept = total.withColumn("worst", F.max("total").over(by_rank)).where(F.col("worst") <= most)
    gap = F.coalesce(F.lag("k").over(down) != F.col("k") - 1, F.lit(False))
    shown = kept.select("id", "k", F.when(gap, F.concat(F.lit(GAP + "\n"), F.col("line"))).otherwise(F.col("line")).alias("line"))
    views = shown.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("view"))
    return rows.join(views, "id", "left").select("id", F.when(F.size(F.split(body, "\n", -1)) <= most, F.col("body")).otherwise(F.coalesce("view", F.lit(""))).alias("view"))


ANSWER = r"(?i)^\s*[-*]?\s*\[?(\d+)\]?\s*[:.)\-]?\s*(keep|drop)\b[\s:,\-]*(.*)$"


def ask_batch(candidates: DataFrame, most: int = 20, chars: int = 2000) -> DataFrame:
    """``entry, item, index, text``: the unsure candidates to ask about at once, in the order of their items."""
    first = candidates.where("verdict = 'unsure'").orderBy("place", "index").limit(most)
    asked = first.withColumn("entry", F.row_number().over(Window.orderBy("place", "index")) - 1)
    return asked.select("entry", "item", "index", text.trimmed(F.substring("text", 1, chars)).alias("text"))


def answers(lines: DataFrame, chars: int = 120) -> DataFrame:
    """``entry, verdict, reason`` from the lines of an answer (``line_no, line``); the first for an entry counts."""
    part = lambda k: F.regexp_extract("line", ANSWER, k)
    said = lines.where(F.col("line").rlike(ANSWER)).select("line_no", part(1).cast("int").alias("entry"), F.lower(part(2)).alias("verdict"), F.substring(F.trim(part(3)), 1, chars).alias("reason"))
    first = F.min_by(F.struct("verdict", "reason"), "line_no")
    return said.groupBy("entry").agg(first.alias("a")).select("entry", "a.verdict", "a.reason")


def heading_order(records: DataFrame, required: DataFrame) -> DataFrame:
    """``id, heading, before``: required headings that come before the one that should precede them.

    ``records``: ``id, type, body``; ``required``: ``type, heading, pos``.
    """
    found = records.select("id", "type", F.explode(markdown.structure(F.col("body"), "sections")["sections"]).alias("s")).select("id", "type", "s.heading", "s.line")
    placed = found.groupBy("id", "type", "heading").agg(F.min("line").alias("line"), F.count(F.lit(1)).alias("n")).where("n = 1").join(F.broadcast(required), ["type", "heading"])
    w = Window.partitionBy("id").orderBy("pos")
    return placed.withColumn("before", F.lag("heading").over(w)).withColumn("prev", F.lag("line").over(w)).where("line < prev").select("id", "heading", "before")
