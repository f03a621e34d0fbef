"""Markdown bodies of records: their structure, links and names, and the texts that are made from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.config import LEAD_HEADINGS
from tidewell.functions import text as texts

#: What a link, a span of code, a list item, a heading and a name in code look like. Fixed values.
LINK = r'(?U)(!?)\[[^\]]*\]\(\s*<?([^)\s>]+)>?(?:\s+"[^"]*")?\s*\)'
SPAN = r"`+[^`]*`+"
ITEM = r"(?U)^ {0,3}([-*+]|\d+[.)])(\s|$)"
HEADING = r"(?s)^(#{1,2})(?!#)(?:[ \t](.*))?$"
COMMIT = r"^(?=.*[0-9])[0-9a-f]{7,40}$"
PATH = r"^(?!.*\.\.)(\./|[A-Za-z0-9_])[A-Za-z0-9._/-]*$"
EXTENSION = r"\.(?=[^./]*[A-Za-z])[A-Za-z0-9_-]{1,5}$"

#: A unit of a body whose lines are numbered: a fenced block with its lines up to one that closes it (at least as many
#: of the same marks and nothing else) or to the end, or any other line.
UNIT = r"(?md)^\d+\t {0,3}((`|~)\2{2,})[^\n]*(?s:.*?)(?:\n\d+\t {0,3}\1\2*(?U:[^\S\n]*)$|\z)|^[^\n]+$"
#: Words of the kinds of units, one letter each: fenced block, blank line, indented line, list item, other text. An
#: indented line after an item belongs to the list until other text comes; else it is code after a blank line, code or
#: nothing.
IN_LIST, CODE = (r"(I[BF]*|\G(?!^)[BF]*)D", "$1d"), (r"(^|B|\G(?!^))D", "$1C")

PARTS = ("first", "titles", "sections", "fences", "code", "links", "anchors")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def units(body: Column) -> Column:
    """array of (n, kind, raw): the units of a body in order with the number of their first line (from 1), their letter
    (``F``, ``B``, ``I``, ``T``; ``C`` for code and ``d`` for indented lines that aren't) and their lines as they are."""
    text = F.regexp_replace(F.coalesce(body, F.lit("")), r"\n\z", "")
    numbered = F.array_join(F.transform(F.split(text, "\n", -1), lambda x, k: F.concat((k + 1).cast("string"), F.lit("\t"), x)), "\n")
    cut = F.transform(
        F.regexp_extract_all(numbered, F.lit(UNIT), F.lit(0)),
        lambda u: F.struct(F.substring_index(u, "\t", 1).cast("int").alias("n"), F.regexp_replace(u, r"(?md)^\d+\t", "").alias("raw")),
    )

    def letter(raw: Column) -> Column:
        kind = F.when(raw.rlike(r"^ {0,3}(```|~~~)"), "F").when(raw.rlike(r"(?U)^\s*$"), "B").when(raw.rlike(r"^(    |\t)"), "D")
        return kind.when(raw.rlike(ITEM), "I").otherwise("T")

    def placed(found: Column) -> Column:
        word = F.array_join(F.transform(found, lambda u: letter(u["raw"])), "")
        letters = F.split(F.regexp_replace(F.regexp_replace(word, *map(F.lit, IN_LIST)), *map(F.lit, CODE)), "")
        return bound(letters, lambda x: F.transform(found, lambda u, k: F.struct(u["n"].alias("n"), F.when(F.get(x, k) == "D", "d").otherwise(F.get(x, k)).alias("kind"), u["raw"].alias("raw"))))

    return bound(cut, placed)


def _line(unit: Column) -> Column:
    """The first line of a unit, without the end that it may have of another system."""
    return F.regexp_replace(F.substring_index(unit["raw"], "\n", 1), r"\r\z", "")


def _prose(unit: Column) -> Column:
    return unit["kind"].isin("I", "T", "d")


def anchor(span: Column) -> Column:
    """What a span of code names: (kind, name) of a commit or a relative path, or null."""
    name = F.regexp_replace(span, r"(?U)^`+\s*|\s*`+$", "")
    path = name.rlike(PATH) & (name.contains("/") | name.rlike(EXTENSION))
    shown = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("name"))
    return F.when(name.rlike(COMMIT), shown("commit", name)).when(path, shown("path", F.regexp_replace(name, r"^(\./)+", "")))


def structure(body: Column, *only: str) -> Column:
    """``first`` line with text, ``titles`` (H1), ``sections`` (H2), ``fences``, lines of indented ``code``, ``links`` and
    ``anchors`` (paths and commits named in code), or ``only`` some of these; lines are counted from 1.

    A section is filled if text or a fence comes after its heading; a heading is text of the section before it.
    """

    def parts(found: Column) -> Column:
        prose = F.filter(found, _prose)
        heads = F.filter(F.transform(prose, lambda u: F.struct(u["n"].alias("line"), _line(u).alias("text"))), lambda x: x["text"].rlike(HEADING))
        level = lambda k: F.filter(heads, lambda x: F.char_length(F.regexp_extract(x["text"], HEADING, 1)) == k)
        words = lambda x: texts.trimmed(F.regexp_replace(texts.trimmed(F.regexp_extract(x["text"], HEADING, 2)), "#+$", ""))
        blocks = F.filter(found, lambda u: u["kind"] == "F")
        last = F.coalesce(F.array_max(F.transform(F.filter(found, lambda u: _prose(u) | (u["kind"] == "F")), lambda u: u["n"])), F.lit(0))

        def sections() -> Column:
            starts = level(2)

            def one(x: Column, k: Column) -> Column:
                end = F.coalesce(F.get(starts, k + 1)["line"], F.lit(1 << 30))
                within = F.filter(F.transform(blocks, lambda u, j: F.struct(u["n"].alias("n"), j.alias("j"))), lambda f: (f["n"] > x["line"]) & (f["n"] < end))
                return F.struct(words(x).alias("heading"), x["line"].alias("line"), (last > x["line"]).alias("filled"), F.transform(within, lambda f: f["j"]).alias("fences"))

            return F.transform(starts, one)

        def links() -> Column:
            of = lambda u: F.transform(
                F.regexp_extract_all(F.regexp_replace(_line(u), SPAN, ""), F.lit(LINK), F.lit(0)),
                lambda m: F.struct(u["n"].alias("line"), F.regexp_extract(m, LINK, 2).alias("target"), m.startswith("!").alias("image")),
            )
            return F.flatten(F.transform(prose, of))

        def anchors() -> Column:
            spans = F.flatten(F.transform(F.filter(found, lambda u: _prose(u) | (u["kind"] == "C")), lambda u: F.regexp_extract_all(_line(u), F.lit(SPAN), F.lit(0))))
            return F.array_distinct(F.filter(F.transform(spans, anchor), lambda a: a.isNotNull()))

        made = {
            "first": lambda: F.get(F.filter(found, lambda u: u["kind"] != "B"), F.lit(0))["n"],
            "titles": lambda: F.transform(level(1), lambda x: F.struct(x["line"].alias("line"), words(x).alias("text"))),
            "sections": sections,
            "fences": lambda: F.transform(blocks, lambda u: F.struct(u["n"].alias("line"), F.regexp_extract(_line(u), r"(?U)^ {0,3}(?:`+|~+)\s*(\S*)", 1).alias("lang"))),
            "code": lambda: F.transform(F.filter(found, lambda u: u["kind"] == "C"), lambda u: u["n"]),
            "links": links,
            "anchors": anchors,
        }
        return F.struct(*[made[p]().alias(p) for p in only or PARTS])

    return bound(units(body), parts)


#: What a line of prose is made of when links are rewritten: links, spans of code, and what is between.
PIECE = LINK + "|" + SPAN + r"|[^\[!`]+|(?s:.)"


def rewritten(body: Column, links: Column) -> Column:
    """``body`` with the targets of links replaced; ``links`` maps "line target" to the new target. Links in code stay."""

    def piece(m: Column, n: Column) -> Column:
        target = F.regexp_extract(m, LINK, 2)
        new = F.get(F.filter(F.map_values(F.map_filter(links, lambda k, _: k == F.concat(n.cast("string"), F.lit(" "), target))), lambda v: v.isNotNull()), F.lit(0))
        begin = F.regexp_extract(m, r"(?U)^!?\[[^\]]*\]\(\s*<?", 0)
        rest = F.substr(m, F.char_length(begin) + F.char_length(target) + 1)
        return F.when(m.rlike("^!?\\[") & (target != "") & new.isNotNull(), F.concat(begin, new, rest)).otherwise(m)

    def line(u: Column) -> Column:
        return F.when(_prose(u), F.array_join(F.transform(F.regexp_extract_all(u["raw"], F.lit(PIECE), F.lit(0)), lambda m: piece(m, u["n"])), "")).otherwise(u["raw"])

    whole = F.array_join(F.transform(units(body), line), "\n")
    return F.when(links.isNull(), body).otherwise(F.concat(whole, F.regexp_extract(body, r"\n?\z", 0)))


def title(found: Column, otherwise: Column) -> Column:
    """The first H1 of a ``structure``."""
    return F.coalesce(F.get(found["titles"], F.lit(0))["text"], otherwise)


def section(body: Column, found: Column, heading: str | Column) -> Column:
    """The text under the first H2 of that name, up to the next H2; null if there is none."""
    name = F.lit(heading) if isinstance(heading, str) else heading
    at = F.array_position(F.transform(found["sections"], lambda s: s["heading"]), name).cast("int")
    lines = F.split(F.regexp_replace(body, r"\n\z", ""), "\n", -1)
    start = F.get(found["sections"], F.greatest(at, F.lit(1)) - 1)["line"]
    end = F.coalesce(F.get(found["sections"], at)["line"] - 1, F.size(lines))
    return F.when(at > 0, F.array_join(F.slice(lines, start + 1, F.greatest(end - start, F.lit(0))), "\n"))


def lead(kind: Column) -> Column:
    """The heading that begins a record of a type."""
    return F.create_map(*[F.lit(x) for pair in LEAD_HEADINGS.items() for x in pair])[kind]


def summary(body: Column, found: Column, kind: Column) -> Column:
    """The first sentence of the lead section, outside fences and without its list mark."""
    return texts.first_sentence(F.regexp_replace(section(body, found, lead(kind)), r"(?ms)^[ \t]*(```|~~~)[^\n]*$.*?(^[ \t]*(```|~~~)[^\n]*$|\z)", ""))


def headings(body: Column) -> Column:
    """All lines that begin like an H2, joined; search counts them without looking for fences."""
    return F.array_join(F.regexp_extract_all(body, F.lit(r"(?m)^## (.*)$"), F.lit(1)), " ")


def resolve(source: Column, target: Column) -> Column:
    """struct(checked, path): where a link of the file ``source`` leads. Links with a scheme, absolute paths and bare
    anchors aren't checked; a path is null if it leaves the tree."""
    bare = F.replace(F.regexp_replace(target, r"(?s)[#?].*$", ""), F.lit("%20"), F.lit(" "))
    skipped = target.contains("://") | target.startswith("mailto:") | target.startswith("#") | target.startswith("/") | (bare == "")
    folder = F.split(source, "/", -1)
    start = F.struct(F.slice(folder, F.lit(1), F.size(folder) - 1).alias("parts"), F.lit(False).alias("left"))

    def step(s: Column, x: Column) -> Column:
        kept = F.struct(s["parts"].alias("parts"), s["left"].alias("left"))
        up = F.struct(F.slice(s["parts"], F.lit(1), F.greatest(F.size(s["parts"]) - 1, F.lit(0))).alias("parts"), (s["left"] | (F.size(s["parts"]) == 0)).alias("left"))
        down = F.struct(F.array_append(s["parts"], x).alias("parts"), s["left"].alias("left"))
        return F.when((x == "") | (x == "."), kept).when(x == "..", up).otherwise(down)

    path = F.aggregate(F.split(bare, "/", -1), start, step, lambda s: F.when(~s["left"], F.array_join(s["parts"], "/")))
    return F.struct((~skipped).alias("checked"), F.when(~skipped, path).alias("path"))


def relative(source: Column, target: Column) -> Column:
    """The link from the file ``source`` to the file ``target``."""
    here, there = F.split(source, "/", -1), F.split(target, "/", -1)
    folder = F.slice(here, F.lit(1), F.size(here) - 1)
    same = F.zip_with(folder, F.slice(there, F.lit(1), F.size(there) - 1), lambda a, b: a.eqNullSafe(b) & a.isNotNull())
    shared = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same)).cast("int")
    up = F.array_repeat(F.lit(".."), F.size(folder) - shared)
    return F.array_join(F.concat(up, F.slice(there, shared + 1, F.size(there))), "/")


def address(url: Column) -> Column:
    """``host/path`` of a remote, whatever its scheme, user, port and ending."""
    bare = F.trim(url)
    scheme = F.regexp_extract(bare, r"^[^/]*://(?:[^/@]*@)?([^/:@]*)(?::[^/]*)?(?:/(.*))?$", 1)
    shell = bare.rlike(r"^[^/:]+:")
    host = F.when(bare.contains("://"), scheme).when(shell, F.substring_index(F.substring_index(bare, ":", 1), "@", -1)).otherwise(F.substring_index(bare, "/", 1))
    rest = (
        F.when(bare.contains("://"), F.regexp_extract(bare, r"^[^/]*://[^/]*/(.*)$", 1))
        .when(shell, F.regexp_replace(bare, r"^[^:]*:", ""))
        .otherwise(F.regexp_extract(bare, r"^[^/]*/(.*)$", 1))
    )
    clean = lambda p: F.rtrim(F.regexp_replace(F.regexp_replace(p, r"^/+|/+$", ""), r"\.git$", ""), F.lit("/"))
    return F.when(bare.rlike(r"^[/.]"), clean(bare)).otherwise(F.concat(F.lower(host), F.lit("/"), clean(rest)))


def glob(pattern: Column) -> Column:
    """A shell pattern as a regular expression for ``rlike``: * and ? cross folders, [..] is a class."""
    quoted = F.regexp_replace(pattern, r"([.+^$(){}|\\])", r"\\$1")
    some = F.replace(F.replace(quoted, F.lit("**"), F.lit("*")), F.lit("*"), F.lit(".*"))
    return F.concat(F.lit("^(?s:"), F.replace(F.replace(some, F.lit("?"), F.lit(".")), F.lit("[!"), F.lit("[^")), F.lit(")$"))


def without_reminders(text: Column) -> Column:
    """A text without the spans that a harness puts in; one that isn't closed goes to the end."""
    return texts.trimmed(F.regexp_replace(text, r"(?s)<system-reminder>.*?(</system-reminder>|\z)", ""))


def flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def quotes_match(quotes: Column, body: Column) -> Column:
    """Whether there are quotes and the body holds each, whatever the white space."""
    held = flat(body)
    return (F.size(quotes) > 0) & F.forall(quotes, lambda q: (flat(q) != "") & held.contains(flat(q)))


def word_line(text: Column) -> Column:
    """The words of a text, with one space before and after each."""
    return F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{M}\p{Nd}\p{Pc}.\-]+"), F.lit(0)), " "), F.lit(" "))


def quotes_error(error: Column, body: Column) -> Column:
    """Whether a quote of two words or more in backticks, of eight characters or more, stands in the error."""
    quotes = F.regexp_extract_all(body, F.lit(r"`([^`\n]{8,})`"), F.lit(1))
    return F.exists(quotes, lambda q: F.trim(word_line(q)).contains(" ") & F.contains(word_line(error), word_line(q)))


def holds_commands(body: Column) -> Column:
    return body.contains("```") | body.contains("https://") | body.contains("http://")


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws(":", F.least(a, b), F.greatest(a, b))


def pair_hash(a: Column, text_a: Column, b: Column, text_b: Column) -> Column:
    """16 hex digits over both texts, whichever comes first."""
    first, second = F.when(a <= b, text_a).otherwise(text_b), F.when(a <= b, text_b).otherwise(text_a)
    return F.substring(F.sha2(F.concat(first, F.lit("\0"), second), 256), 1, 16)


def preview(body: Column) -> Column:
    """One line that says what an item is about: its first typed prompt, else its first line; a note as type and text."""
    lines = F.filter(F.transform(F.split(body, "\n", -1), texts.trimmed), lambda x: (x != "") & ~x.startswith("#") & ~(x.startswith("[") & x.endswith(" cut]")))
    said = F.transform(F.filter(lines, lambda x: x.startswith("[user] ")), lambda x: F.substring(x, 8, 1 << 30))
    typed = F.get(F.filter(said, lambda x: ~x.startswith("<")), F.lit(0))
    other = F.get(F.filter(lines, lambda x: ~x.startswith("[user] <")), F.lit(0))
    line = F.coalesce(typed, other, F.lit(""))
    return F.regexp_replace(line, r"^- \d{4}-\d{2}-\d{2} \[\w+\] \((\w+); *\w+\) +(.+)$", "$1: $2")


def description(when: Column, most: int = 1024, start: str = "Load before you") -> Column:
    """A sentence that reads on from ``start``, of as many whole words as fit."""
    words = F.filter(F.split(F.concat(F.lower(F.substring(when, 1, 1)), F.substring(when, 2, 1 << 30)), r"\s+"), lambda w: w != "")
    zero = F.struct(F.lit(start).alias("out"), F.lit(False).alias("full"))
    step = lambda s, w: F.when(
        s["full"] | (F.char_length(s["out"]) + 1 + F.char_length(w) > most), F.struct(s["out"].alias("out"), F.lit(True).alias("full"))
    ).otherwise(F.struct(F.concat(s["out"], F.lit(" "), w).alias("out"), F.lit(False).alias("full")))
    return F.aggregate(words, zero, step, lambda s: s["out"])


def rerank_text(title_: Column, body: Column, found: Column, kind: Column) -> Column:
    """What a reranker reads of a record: title, lead section, cause, fix and steps."""
    part = lambda name: F.concat(F.lit("\n## "), name, F.lit("\n"), texts.trimmed(section(body, found, name)), F.lit("\n"))
    parts = [part(lead(kind)), *[part(F.lit(h)) for h in ("Cause", "Fix", "Steps")]]
    return F.concat(F.lit("# "), title_, F.lit("\n"), *[F.coalesce(p, F.lit("")) for p in parts])


def injected(lessons: Column, tag: str, intro: str, show: str, one: int = 300, most: int = 1200) -> Column:
    """The block that carries records into a context, as data under ``tag``.

    ``lessons``: array of (id, title, summary, verified, how, applies, tier, notes). A candidate is one line, others
    have their summary. Texts are cut to ``one`` characters and can't close the block; records go in while the whole
    stays within ``most``.
    """
    clean = lambda s: F.translate(F.regexp_replace(s, rf"<(/?){tag}", rf"[$1{tag}"), "\n", " ")
    cut = lambda s: F.when(F.char_length(s) <= one, s).otherwise(F.concat(F.substring(s, 1, one - 1), F.lit("…")))

    def block(x: Column) -> Column:
        line = F.concat(F.lit(f'\n<{tag} id="'), x["id"], F.lit('">'), cut(clean(x["title"])), F.lit(f" - `{show} "), x["id"], F.lit(f"`</{tag}>"))
        both = F.concat(clean(x["title"]), F.when(x["summary"] != "", F.concat(F.lit(" - "), clean(x["summary"]))).otherwise(""))
        notes = F.array_join(F.transform(x["notes"], lambda n: F.concat(F.lit("\n"), clean(n))), "")
        head = F.concat(F.lit(f'\n<{tag} id="'), x["id"], F.lit('" verified="'), x["verified"], F.lit('" how="'), x["how"], F.lit('" applies="'), x["applies"], F.lit('">\n'))
        full = F.concat(head, cut(both), notes, F.lit(f"\nRead it with `{show} "), x["id"], F.lit(f"`.\n</{tag}>"))
        return F.when(x["tier"] == "candidate", line).otherwise(full)

    zero = F.struct(F.lit(intro).alias("out"), F.lit(False).alias("full"))
    step = lambda s, b: F.when(
        s["full"] | (F.char_length(s["out"]) + F.char_length(b) > most), F.struct(s["out"].alias("out"), F.lit(True).alias("full"))
    ).otherwise(F.struct(F.concat(s["out"], b).alias("out"), F.lit(False).alias("full")))
    return F.aggregate(F.transform(lessons, block), zero, step, lambda s: s["out"])
