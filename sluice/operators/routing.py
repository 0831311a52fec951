"""Routing predicates, prices and the ledger of what each configuration would have spent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import CUES, DOUBTS, MAX_CHARS, bound, contains_any, is_blank, py_bool

# fixed values: what routers give as their reason
EASY, ESCALATED, CONFIDENT = "short and no reasoning cue", "cheap answer uncertain or empty", "cheap answer confident"


def heuristic(request: Column, max_chars: int = MAX_CHARS, cues: tuple[str, ...] = CUES) -> Column:
    """``struct(hard, reason)``: hard if longer than ``max_chars`` code points or with a cue in it. A null request is easy."""
    long = F.coalesce(F.length(request) > max_chars, F.lit(False))

    def told(cue: Column) -> Column:
        text = F.concat(F.lit("long="), py_bool(long), F.lit(" cue="), py_bool(cue))
        return F.struct((long | cue).alias("hard"), F.when(long | cue, text).otherwise(EASY).alias("reason"))

    return bound(contains_any(request, cues), told)


def cascade(answer: Column, doubts: tuple[str, ...] = DOUBTS) -> Column:
    """True if the cheap answer is blank or voices doubt: ask the expensive model."""
    return is_blank(answer) | contains_any(answer, doubts)


def cascade_reason(answer: Column, doubts: tuple[str, ...] = DOUBTS) -> Column:
    """``struct(escalate, reason)`` of a cheap answer."""
    told = lambda up: F.struct(up.alias("escalate"), F.when(up, ESCALATED).otherwise(CONFIDENT).alias("reason"))
    return bound(cascade(answer, doubts), told)


def cost_usd(tokens_in: Column, tokens_out: Column, price_in: Column | float, price_out: Column | float) -> Column:
    return tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out


def priced(rows: DataFrame, prices: dict[str, tuple[float, float]], model: str = "model") -> DataFrame:
    """Add ``cost_usd`` by each row's model; a model without a price fails the query. The price table is a literal."""
    table = F.create_map(
        *[x for m, (a, b) in prices.items() for x in (F.lit(m), F.struct(F.lit(a).alias("i"), F.lit(b).alias("o")))]
    )
    price = F.try_element_at(table, F.col(model))
    known = F.when(
        price.isNull(),
        F.raise_error(
            F.concat(F.lit("no price for model "), F.coalesce(F.col(model), F.lit("null")))
        ).cast("struct<i:double,o:double>")
    ).otherwise(price)
    return rows.withColumn("_price", known).withColumn(
        "cost_usd", cost_usd(F.col("tokens_in"), F.col("tokens_out"), F.col("_price.i"), F.col("_price.o"))
    ).drop("_price")


def dispatch(rows: DataFrame) -> DataFrame:
    """What each row costs under its ``config``.

    Takes ``config, hit_kind, stored_by, hard, escalate`` and tokens and seconds of both tiers
    (``cheap_in, cheap_out, cheap_ms, dear_in, dear_out, dear_ms``). A hit has no tokens and the tier of the stored answer; an escalated row pays both tiers.
    """
    hit = F.col("hit_kind").isin("cache_exact", "cache_semantic") & (F.col("config") != "baseline")
    both = (F.col("config") == "router_cascade") & F.col("escalate")
    cheap = (
        (F.col("config") == "router_cascade") & ~F.col("escalate")
    ) | ((F.col("config") == "router_heuristic") & ~F.col("hard"))
    out = {
        "kind": F.when(F.col("config") == "baseline", "model_direct").when(hit, F.col("hit_kind")).otherwise("miss"),
        "served_by": F.when(hit, F.col("stored_by")).when(cheap, "cheap").otherwise("expensive"),
    }
    for x, name in (("in", "tokens_in"), ("out", "tokens_out"), ("ms", "model_ms")):
        out[name] = F.when(hit, 0).when(
            both, F.col(f"cheap_{x}") + F.col(f"dear_{x}")
        ).when(cheap, F.col(f"cheap_{x}")).otherwise(F.col(f"dear_{x}"))
    return rows.withColumns(out)


def retry_blank(first: Column, second: Column) -> Column:
    """A completion asked again with twice the budget where the first was blank; both calls are billed. Structs of ``text, tokens_in, tokens_out, ms``."""
    again = is_blank(first["text"])
    add = lambda c: F.when(again, first[c] + second[c]).otherwise(first[c]).alias(c)
    return F.struct(
        F.when(again, second["text"]).otherwise(first["text"]).alias("text"),
        add("tokens_in"),
        add("tokens_out"),
        add("ms"),
    )


def complete(rows: DataFrame, provider, request: str = "request") -> DataFrame:
    """Rows with ``answer_text, tokens_in, tokens_out`` from ``provider()``: a factory, called once a task, of ``texts -> [(answer, in, out)]``."""
    import pandas as pd

    def run(batches):
        ask = provider()
        for part in batches:
            got = ask(list(part[request]))
            yield part.assign(**pd.DataFrame(got, columns=["answer_text", "tokens_in", "tokens_out"], index=part.index))

    return rows.mapInPandas(
        run, ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), "answer_text string, tokens_in long, tokens_out long"])
    )

