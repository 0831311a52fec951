"""Quality rules: clean line by line, then reject documents that lose too much.

Every line is judged on its own: separators of navigation, symbols strewn among words, the same words over and over, no
punctuation at all, boilerplate. Boilerplate is what the corpus itself repeats (short lines that stand between ever other
neighbours), and stock phrases of web pages, a parameter. Lines that fail are removed. A document goes if more than
``max_loss`` of its words went with them, or if it fails the base rules (too short, or mostly repeated).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import BLOCK, Words, window_hashes, words_of

MIN_WORDS, MAX_REPEAT, MAX_LOSS = 50, 50, 0.5
SYMBOLS = b"#*$%&|<>"
STOCK = (
    b"cookie policy",
    b"enable javascript",
    b"privacy policy",
    b"terms of use",
    b"terms of service",
    b"skip to content",
    b"sign up for",
    b"subscribe to our",
    b"log in to",
    b"click here to",
    b"share on facebook",
    b"share on twitter",
    b"read more",
)
#: Words of the longest line that counts as boilerplate.
SHORT = 25
#: A line is boilerplate of the corpus if it stands between so many different pairs of neighbours, and in so large a share of documents.
CONTEXTS, CONTEXT_SHARE = 50, 1e-4
_BLANK = " \t\n\x0b\f\r"
_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_MARKS = b".,;:!?"
_OTHER_MARKS = tuple(c.encode() for c in "…。、！？؟।»”")


def _plain(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(_BLANK)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def repeated_lines(
    docs: DataFrame, text: str = "text", contexts: int = CONTEXTS, share: float = CONTEXT_SHARE
) -> DataFrame:
    """``line``: hashes of lines that are boilerplate of the corpus, over all documents and whole texts.

    A copied document repeats its lines between the same neighbours, however often; boilerplate stands between other ones
    in each document. A line counts if its pairs of neighbours (blank lines left out) are at least ``contexts`` and at
    least ``share`` of the documents with text; so there are at most 1 / ``share`` times the lines of a document on
    average. Counts are pre-aggregated; a line's places are never gathered. A document's only line has no neighbours and
    teaches nothing.
    """
    body = docs.select(F.col(f"`{text}`").cast("string").alias("text")).where("text IS NOT NULL")
    lines = F.filter(F.transform(F.split("text", "\n"), _plain), lambda x: x != "")
    hashed = body.select(F.transform(lines, lambda x: F.xxhash64(x)).alias("h")).where(F.size("h") > 1)
    near = F.transform(
        "h",
        lambda x, i: F.struct(
            x.alias("line"), F.xxhash64(F.when(i > 0, F.get("h", i - 1)), F.lit(0), F.get("h", i + 1)).alias("at")
        ),
    )
    places = hashed.select(F.explode(near).alias("p")).select("p.*").distinct()
    least = max(contexts, int(np.ceil(share * body.count())))
    return places.groupBy("line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("line")


def line_fails(
    line: bytes, boilerplate: frozenset[int] | set[int] = frozenset(), stock: tuple[bytes, ...] = STOCK
) -> str | None:
    """The rule that a line with words fails, or None. ``boilerplate``: hashes of ``repeated_lines``."""
    words = line.split()
    n = len(words)
    if line.count(b"|") * 4 >= n and line.count(b"|") >= 3:
        return "navigation"
    if (len(line) - len(line.translate(None, b"#*$%&<>"))) >= max(6, n):
        return "symbols"
    if n >= 12 and len(set(words)) * 3 <= n:
        return "repeats"
    if n >= 12 and len(line) == len(line.translate(None, _MARKS)) and not any(m in line for m in _OTHER_MARKS):
        return "punctuation"
    if n <= SHORT:
        low = line.lower()
        if any(s in low for s in stock):
            return "boilerplate"
        if boilerplate and xxhash.xxh64_intdigest(low.strip(), seed=42) in boilerplate:
            return "boilerplate"
    return None


def _repeat_words(h: np.ndarray) -> int:
    w = window_hashes(h, 3)
    if not len(w):
        return 0
    _, back, count = np.unique(w, return_inverse=True, return_counts=True)
    twice = count[back] >= 2
    mark = np.zeros(len(h), dtype=bool)
    for k in range(3):
        mark[k : k + len(w)] |= twice
    return int(mark.sum())


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_lines long, failed_lines long, lost_words long, kept boolean, cleaned string"


def judge_documents(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    max_loss: float = MAX_LOSS,
    cleaned: bool = True,
    carry: tuple[str, ...] = (),
    stock: tuple[bytes, ...] = STOCK,
) -> DataFrame:
    """``doc_id``, the counts, ``kept`` and the ``cleaned`` text (lines that fail removed; null unless asked for) of each row.

    Words are runs of other than ASCII white space, over the whole text. A null or blank
    text has no words, so it fails the base rules. One line of any length is judged
    like others; a text without newlines is one line. Rows are kept as they are,
    with equal or null ids too, and their columns in ``carry`` come along, one that is named like a column of this
    operator as ``carried_`` and its name; an empty table gives an empty one. Boilerplate lines are found first, by a pass
    over all documents (``repeated_lines``); their hashes go to each task.
    """
    own = {"doc_id", *(c.split()[0] for c in COLUMNS.split(", "))}
    named = [f"carried_{c}" if c in own else c for c in carry]
    carried = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(carry, named)])
    # the text itself goes to a task once
    apart = [c for c in carry if not (c == text and dict(docs.dtypes)[c] == "string")]
    places = [2 + apart.index(c) if c in apart else 1 for c in carry]
    common = {r["line"] & (1 << 64) - 1 for r in repeated_lines(docs, text).collect()}  # bounded, see there
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(common))

    def lines(w: Words, i: int) -> tuple[int, int, int, int, bytes]:
        body = w.data[w.offsets[i] : w.offsets[i + 1]].tobytes()
        seen: set[bytes] = set()
        repeated = failed = lost = total = 0
        kept = []
        for line in body.split(b"\n"):
            if not line.strip():
                kept.append(line)
                continue
            total += 1
            repeated += line in seen
            seen.add(line)
            if line_fails(line, shared.value, stock):
                failed += 1
                lost += len(line.split())
            else:
                kept.append(line)
        return repeated, total, failed, lost, b"\n".join(kept) if failed else body

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words_of(batch.column(1), limit=BLOCK):
                n = np.diff(w.first)
                starts = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
                chars = np.concatenate([[0], np.cumsum(starts[w.end] - starts[w.start])])
                symbols = np.concatenate([[0], np.cumsum(_IS_SYMBOL[w.data])])
                repeat = np.array(
                    [_repeat_words(w.hash[a:b]) for a, b in zip(w.first[:-1], w.first[1:])], dtype=np.int64
                )
                dup, total, failed, lost, clean = zip(*(lines(w, i) for i in range(len(n))))
                base = (n < MIN_WORDS) | (100 * repeat > MAX_REPEAT * n)
                kept = ~base & (np.array(lost) <= max_loss * n)
                yield pa.record_batch(
                    [
                        batch.column(0)[w.rows],
                        pa.array(n.astype(np.int64)),
                        pa.array(chars[w.first[1:]] - chars[w.first[:-1]]),
                        pa.array(symbols[w.offsets[1:]] - symbols[w.offsets[:-1]]),
                        pa.array(dup, pa.int64()),
                        pa.array(repeat),
                        pa.array(base),
                        pa.array(total, pa.int64()),
                        pa.array(failed, pa.int64()),
                        pa.array(lost, pa.int64()),
                        pa.array(kept),
                        pa.array([c.decode() for c in clean] if cleaned else [None] * len(n), pa.string()),
                        *(batch.column(i)[w.rows] for i in places),
                    ],
                    names=["doc_id", *(c.split()[0] for c in COLUMNS.split(", ")), *named],
                )
            pa.default_memory_pool().release_unused()

    narrow = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("_id"),
        F.col(f"`{text}`").cast("string").alias("_text"),
        *(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(apart)),
    )
    return narrow.mapInArrow(run, ", ".join([f"doc_id long, {COLUMNS}", *(f"`{c}` {t}" for c, t in carried.dtypes)]))
