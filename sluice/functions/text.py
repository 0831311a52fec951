"""Text as columns: folding, exact keys, phrase tests, score and label parsing."""

from __future__ import annotations

import unicodedata
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: phrases that decide a route, as the workload's configuration states them
CUES = ("why", "compare", "steps", "reason", "because", "how", "solve", "calculate", "difference", "prove", "justify")
DOUBTS = ("not sure", "uncertain", "cannot", "can't", "can’t", "i don't know", "i don’t know", "unable", "sorry")
MAX_CHARS = 240
# fixed values: marks around a judge's score, and spellings of labels
SCORE_MARKS = ".,:;!?()[]{}\"'`"
LABELS = {
    "2": "correct",
    "1": "partial",
    "0": "incorrect",
    "2.0": "correct",
    "1.0": "partial",
    "0.0": "incorrect",
    "correct": "correct",
    "incorrect": "incorrect",
    "partial": "partial",
}
MISSING = ("", "nan", "none", "na")
#: White space as Python has it: that of Unicode and the four separators.
SPACE = r"(?U)[\s\x1C-\x1F]+"
#: White space other than a single blank, and anything else than white space.
UNEVEN, INK = r"(?U) [\s\x1C-\x1F]+|[\s\x1C-\x1F&&[^ ]][\s\x1C-\x1F]*", r"(?U)[^\s\x1C-\x1F]"


def _folds() -> tuple[str, str, dict[str, str]]:
    """Letters that fold to one letter, these letters, and what others fold to, by Python's own tables."""
    told = {c: f for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff" and (f := c.casefold()) != c}
    one = {c: f for c, f in told.items() if len(f) == 1}
    return "".join(one), "".join(one.values()), {c: f for c, f in told.items() if len(f) > 1}


_FROM, _TO, _LONGER = _folds()
#: Letters that stand in many texts and that ``lower`` does not fold; these are replaced beforehand.
_COMMON = {"ß": "ss", "Σ": "σ", "ς": "σ"}
#: Parts of Unicode with letters that ``lower`` does not fold.
_AREAS = ((0xB5, 0xB5), (0x130, 0x1FFF), (0x2C00, 0x2DFF), (0xA640, 0xABFF), (0xFB00, 0xFB17), (0x10000, 0x1EFFF))


def _unlike_lower() -> str:
    """A class of all characters that ``lower`` may leave unlike their folding, but for the common ones.

    Those whose folding differs by Python's tables, and those that these don't know but newer tables of a JVM may.
    """
    areas = []
    for low, high in _AREAS:
        odd = [
            n for n in range(low, high + 1)
            if chr(n) not in _COMMON and (chr(n).casefold() != chr(n).lower() or len(chr(n).lower()) > 1 or unicodedata.category(chr(n)) == "Cn")
        ]
        known = set(odd)
        ends = zip((n for n in odd if n - 1 not in known), (n for n in odd if n + 1 not in known))
        ranges = "".join(f"\\x{{{x:X}}}-\\x{{{y:X}}}" for x, y in ends)
        areas.append(f"[\\x{{{low:X}}}-\\x{{{high:X}}}&&[{ranges}]]")
    return "|".join(areas)


_ODD = _unlike_lower()


def bound(value: Column, f) -> Column:
    """``f(value)`` with ``value`` computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def fold(text: Column) -> Column:
    """Full Unicode case folding in the JVM: ``lower`` where it folds, else letters that become one letter by a table, the hundred others one after the other.

    Which way a text goes is shown by classes of letters.
    """
    for c, f in _COMMON.items():
        text = F.replace(text, F.lit(c), F.lit(f))
    pairs = F.array(*(F.struct(F.lit(c).alias("c"), F.lit(f).alias("f")) for c, f in _LONGER.items()))
    longer = F.aggregate(pairs, text, lambda t, p: F.replace(t, p["c"], p["f"]))
    plain = F.when(text.rlike(f"[{''.join(_LONGER)}]"), longer).otherwise(text)
    odd = (F.octet_length(text) != F.length(text)) & text.rlike(_ODD)
    return F.when(odd, F.translate(plain, _FROM, _TO)).otherwise(F.lower(text))


def normalize_exact(text: Column) -> Column:
    """The key by which repeated requests are found: folded, white space collapsed and stripped. Null stays null."""
    return F.trim(F.regexp_replace(fold(text), UNEVEN, " "))


def contains_any(text: Column, phrases: tuple[str, ...]) -> Column:
    """True if the folded text holds one of ``phrases``; false for null."""
    holds = lambda t: reduce(or_, (F.contains(t, F.lit(p)) for p in phrases), F.lit(False))
    return F.coalesce(bound(fold(text), holds), F.lit(False))


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(INK)


def request_text(sentence: Column, template: str = 'Explain this statement: "{sentence}"') -> Column:
    head, _, tail = template.partition("{sentence}")
    return F.concat(F.lit(head), sentence, F.lit(tail))


def group_name(number: Column) -> Column:
    return F.format_string("g%05d", number)


# fixed value: the layout of a judge's prompt
def judge_prompt(rubric: str, request: Column, reference: Column, candidate: Column) -> Column:
    return F.concat(
        F.lit(f"{rubric}\n\nREQUEST: "),
        request,
        F.lit("\n\nANSWER_A (reference): "),
        reference,
        F.lit("\n\nANSWER_B (candidate): "),
        candidate,
        F.lit("\n\nSCORE:"),
    )


def parse_score(reply: Column) -> Column:
    """0, 1 or 2 of a judge's reply: the first word that is one, marks stripped; else the first digit that stands alone; else null."""
    words = F.transform(F.split(reply, r"(?U)\s+"), lambda w: F.btrim(w, F.lit(SCORE_MARKS)))
    word = F.get(F.filter(words, lambda w: w.isin("0", "1", "2")), F.lit(0))
    digit = F.nullif(F.regexp_extract(reply, r"(?<!\d)([012])(?!\d)", 1), F.lit(""))
    return F.coalesce(word, digit).cast("int")


def normalize_label(label: Column) -> Column:
    """``correct``, ``partial`` or ``incorrect``; null where there is none; other words as they are."""
    low = F.trim(F.lower(label))
    known = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.when(low.isNull() | low.isin(*MISSING), None).otherwise(F.coalesce(F.try_element_at(known, low), low))


def checked_label(label: Column) -> Column:
    """Like ``normalize_label``, but the query fails on a word that is no label."""
    name = normalize_label(label)
    bad = name.isNotNull() & ~name.isin(*set(LABELS.values()))
    return F.when(bad, F.raise_error(F.concat(F.lit("not a label: "), label)).cast("string")).otherwise(name)


def has_error(error: Column) -> Column:
    return ~F.lower(F.trim(F.coalesce(error, F.lit("")))).isin("", "nan")


def completion_fields(reply: Column) -> Column:
    """Struct of text and token counts of a chat completion in JSON; counts default to 0."""
    count = lambda p: F.coalesce(F.get_json_object(reply, f"$.usage.{p}").cast("long"), F.lit(0))
    return F.struct(
        F.get_json_object(reply, "$.choices[0].message.content").alias("text"),
        count("prompt_tokens").alias("tokens_in"),
        count("completion_tokens").alias("tokens_out"),
    )


def py_bool(value: Column) -> Column:
    return F.when(value, "True").otherwise("False")
