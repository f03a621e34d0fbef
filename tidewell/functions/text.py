"""Text functions as Column expressions; everything here runs in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.config import CORRECTION, ERROR_LINE, REMEMBER, STOP_WORDS, TOOL_BLOCKS, Gates

RUNS = r"[\p{L}\p{N}_./:@-]+"
EDGE = r"^[_./:@-]+|[_./:@-]+$"
PLAIN = r"^[A-Za-z0-9][a-z0-9]*$"
VERSION = r"^[vV]?[0-9][A-Za-z0-9._-]*$"
#: A capital that begins a part: before a capital and a small letter, or after a small letter or digit.
CAPITALS = r"(\p{Lu})(?=\p{Lu}\p{Ll})"
HUMPS = r"([\p{Ll}0-9])(?=\p{Lu})"


def _kept(term: Column) -> Column:
    return (F.char_length(term) >= 2) & ~term.isin(*STOP_WORDS)


def is_version(raw: Column) -> Column:
    return raw.rlike(VERSION) & raw.rlike("[._-]")


def tokens(text: Column) -> Column:
    """The search terms of a text, in order, repeats included. Null gives null.

    Plain words are lower-cased; versions are kept whole; other compound words give the whole and then their parts.
    Terms of one character and stop words are dropped, versions never.
    """
    none = F.array().cast("array<string>")

    def kept(whole: Column) -> Column:
        return F.when(_kept(whole), F.array(whole)).otherwise(none)

    def of(raw: Column) -> Column:
        whole = F.lower(raw)
        broken = F.regexp_replace(F.regexp_replace(raw, CAPITALS, "$1 "), HUMPS, "$1 ")
        parts = F.filter(F.transform(F.split(broken, "[_./:@ -]"), F.lower), _kept)
        more = (F.size(parts) > 1) | ((F.size(parts) == 1) & (F.get(parts, F.lit(0)) != whole))
        compound = F.when(more, F.concat(kept(whole), parts)).otherwise(kept(whole))
        return F.when(raw.rlike(PLAIN), kept(whole)).when(is_version(raw), F.array(whole)).otherwise(compound)

    def run(w: Column) -> Column:
        """Most runs are plain words, which have nothing to strip; the others take several patterns each."""
        stripped = F.filter(F.array(F.regexp_replace(w, EDGE, "")), lambda x: x != "")
        return F.when(w.rlike(PLAIN), kept(F.lower(w))).otherwise(F.flatten(F.transform(stripped, of)))

    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(RUNS), F.lit(0)), run))


def lines(text: Column) -> Column:
    """Lines without their ends; a last empty line isn't one."""
    return F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n", -1)


def title(body: Column, otherwise: Column) -> Column:
    found = F.regexp_extract(body, r"(?m)^# (.*)$", 1)
    return F.when(body.rlike(r"(?m)^# "), F.trim(found)).otherwise(otherwise)


def headings(body: Column) -> Column:
    return F.array_join(F.regexp_extract_all(body, F.lit(r"(?m)^## (.*)$"), F.lit(1)), " ")


def trimmed(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def first_sentence(text: Column) -> Column:
    """The first line that isn't blank, without its list mark, up to the end of its first sentence."""
    found = F.regexp_replace(F.regexp_extract(text, r"(?m)^[ \t]*(\S.*)$", 1), r"^[-* ]+", "")
    return F.trim(F.regexp_extract(found, r"^(.*?[.?!](?= )|.*)", 1))


def program(command: Column) -> Column:
    """The program of a shell command: its first word that isn't an assignment, without quotes and folder."""
    word = F.get(F.filter(F.split(F.trim(command), r"\s+"), lambda w: (w != "") & (~w.contains("=") | w.startswith("="))), F.lit(0))
    name = F.substring_index(F.regexp_replace(word, r"""^[('"]+|[('"]+$""", ""), "/", -1)
    return F.when(name != "", name)


def key_lines(error: Column) -> Column:
    """Lines that name the problem, else the last three."""
    all_ = F.filter(F.transform(lines(error), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("Exit code "))
    named = F.filter(all_, lambda x: x.rlike(ERROR_LINE))
    last = F.slice(all_, F.greatest(F.size(all_) - 2, F.lit(1)), F.lit(3))
    return F.when(F.size(named) > 0, named).otherwise(last)


def _dropped(word: Column) -> Column:
    bare = F.regexp_replace(word, r"""^[()\[\]{}:;,"'.]+|[()\[\]{}:;,"'.]+$""", "")
    return word.contains("/") | word.rlike(r"(?i)[0-9a-f]{7,}|\d{4}-\d{2}-\d{2}|\d{2}:\d{2}") | bare.rlike(r"^[0-9.]+$")


def error_query(command: Column, error: Column, most: int = Gates.query_terms) -> Column:
    """A search query for a failed command: its program and the words of the key lines, up to ``most`` terms.

    The first word that would go over ends the query.
    """
    start = F.coalesce(program(command), F.lit(""))
    words = F.filter(F.flatten(F.transform(key_lines(error), lambda x: F.split(x, r"\s+"))), lambda w: (w != "") & ~_dropped(w))
    counted = F.transform(words, lambda w: F.struct(w.alias("w"), F.size(tokens(w)).alias("n")))
    zero = F.struct(start.alias("q"), F.size(tokens(start)).alias("n"), F.lit(False).alias("full"))
    step = lambda s, x: F.when(s["full"] | (s["n"] + x["n"] > most), F.struct(s["q"].alias("q"), s["n"].alias("n"), F.lit(True).alias("full"))).otherwise(
        F.struct(F.concat(s["q"], F.lit(" "), x["w"]).alias("q"), (s["n"] + x["n"]).alias("n"), F.lit(False).alias("full"))
    )
    return F.aggregate(counted, zero, step)["q"]


def signature(command: Column, error: Column) -> Column:
    """24 hex digits that are equal for the same failure on another day or in another folder."""
    # the mask is a fixed value
    masked = F.regexp_replace(error_query(command, error), r"""(/[^\s:'"]+)+|\b[0-9a-f]{7,}\b|\d+""", "#")
    one_space = F.trim(F.regexp_replace(masked, r"\s+", " "))
    return F.substring(F.sha2(F.concat(F.coalesce(program(command), F.lit("")), F.lit("\n"), one_space), 256), 1, 24)


def coverage(error: Column, text: Column, least: int = Gates.line_terms) -> Column:
    """The best share, over the key lines, of a line's distinct terms that a text holds; short lines count nothing."""
    held = F.array_distinct(tokens(text))

    def share(line: Column) -> Column:
        terms = F.array_distinct(F.filter(tokens(line), lambda w: ~w.startswith("0x") & ~w.rlike("^[0-9]+$")))
        return F.when(F.size(terms) >= least, F.size(F.array_intersect(terms, held)) / F.size(terms)).otherwise(F.lit(0.0))

    return F.coalesce(F.array_max(F.transform(key_lines(error), share)), F.lit(0.0))


def typed_text(prompt: Column) -> Column:
    """What was typed: blocks and notices that tools wrote are removed."""
    out = prompt
    for tag in TOOL_BLOCKS:
        out = F.regexp_replace(out, rf"(?s)<{tag}\b[^>]*>.*?</{tag}\b[^>]*>", "")
    # fixed value
    notices = r"(?m)^\s*(Another Claude session sent a message:.*|\[Request interrupted by user.*|\[SYSTEM NOTIFICATION.*)$"
    return F.trim(F.regexp_replace(out, notices, ""))


def prompt_signals(prompt: Column) -> Column:
    """struct(correction, remember) over the sentences that aren't questions."""
    sentences = F.transform(
        F.filter(F.regexp_extract_all(prompt, F.lit(r"[^.!?\n]*[.!?\n]|[^.!?\n]+$"), F.lit(0)), lambda s: ~s.endswith("?")),
        lambda s: F.trim(s),
    )
    return F.struct(
        F.exists(sentences, lambda s: s.rlike(CORRECTION)).alias("correction"), F.exists(sentences, lambda s: s.rlike(REMEMBER)).alias("remember")
    )


def slug(text: Column, most: int = 60) -> Column:
    """Lower-case words joined by hyphens, as many whole words as fit."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.aggregate(
        words,
        F.lit(""),
        lambda s, w: F.when(s == "", F.substring(w, 1, most)).when(F.char_length(s) + F.char_length(w) + 1 <= most, F.concat(s, F.lit("-"), w)).otherwise(s),
    )


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 12)
