"""Personal data in texts, and the terms around it that would give it away.

Method (information-theoretic sanitisation). Patterns find protected entities: e-mail addresses, IP addresses, card
and phone numbers. A term of a document discloses an entity of it as far as knowing the term makes the entity likely:
``PMI(e; t) = log2(p(e | t) / p(e))``, estimated from co-occurrence in the documents of the whole corpus, against the
information ``IC(e) = -log2 p(e)`` that the entity holds. Terms whose PMI reaches ``DISCLOSURE`` of IC, seen with the
entity in at least ``MIN_CONTEXTS`` different contexts of it (copies of one context count once), would let a reader
restore the masked entity. Such a term is generalised to its first ``STEM`` letters where that form, measured alike,
stays below the threshold, and removed otherwise. All terms of a document count, however far from the entity; only
documents that hold the entity are touched, so a document without personal data stays as it is.

Everything is DataFrame and SQL functions. Positions come from splitting a text by the pattern: the lengths of pieces and
matches add up. Patterns are written so that they need time in proportion to a text, however long a run of
digits or letters is. Counts fold in the task before each shuffle; a very common entity or term is a key of folded
counts, never a group.

Defined results: null text counts as empty; an empty text has no spans (the digest is that of the empty string);
repeated rows are rows of their own; null or repeated ``doc_id`` do no harm, since rows are numbered; an empty table gives no row;
clashing columns in the table take no part. Positions count code points, ends are exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from emberfield.session import materialize

#: Share of an entity's information that a term may reveal, and the different contexts that count as evidence.
DISCLOSURE = 0.9
MIN_CONTEXTS = 3
#: Code points on either side of an entity that tell its contexts apart, and letters that a generalised term keeps.
REACH = 80
STEM = 3

# Possessive repeats and look-behinds keep the leftmost non-overlapping matches of the plain patterns but never
# try a run again from its middle, and never nest a call per repeat.
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    # Runs of other than 12 to 19 digits fail anyway, so the pattern passes them by.
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$"
_TERM = r"\p{L}+"
_CHUNK = 256


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, b: a + b)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _before(lengths: Column) -> Column:
    """Sum of all values before each place of an array, by chunks, so that long arrays take little time.

    ``lengths`` must be a bound value (see ``_let``), since every element looks into it.
    """
    chunks = F.sequence(F.lit(0), ((F.size(lengths) - 1) / F.lit(_CHUNK)).cast("int"))
    sums = F.transform(chunks, lambda c: _total(F.slice(lengths, c * _CHUNK + 1, F.lit(_CHUNK))))

    def shifted(starts: Column) -> Column:
        return F.transform(
            lengths,
            lambda _, i: F.get(starts, (i / F.lit(_CHUNK)).cast("int"))
            + _total(F.slice(lengths, i - i % _CHUNK + 1, i % _CHUNK)),
        )

    return _let(sums, lambda s: _let(F.transform(chunks, lambda c: _total(F.slice(s, F.lit(1), c))), shifted))


def matches(text: Column, pattern: str) -> Column:
    """All matches as an array of ``start, value, before, after``: the texts up to the neighbouring matches."""

    def placed(values: Column, pieces: Column) -> Column:
        lengths = F.transform(values, lambda v, i: F.length(F.get(pieces, i)) + F.length(v))
        starts = _let(lengths, _before)
        return F.transform(
            F.arrays_zip(values.alias("v"), starts.alias("s")),
            lambda z, i: F.struct(
                (z["s"] + F.length(F.get(pieces, i))).alias("start"),
                z["v"].alias("value"),
                F.get(pieces, i).alias("before"),
                F.get(pieces, i + 1).alias("after"),
            ),
        )

    none = F.array().cast("array<struct<start:int,value:string,before:string,after:string>>")
    return _let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda v: F.when(F.size(v) > 0, _let(F.split(text, pattern, -1), lambda p: placed(v, p))).otherwise(none),
    )


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(_OCTETS)
    if kind == "card":
        return F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _entities(text: Column, kind: str, order: int) -> Column:
    """Valid matches of a kind; ``context`` is a hash of the text on both sides."""
    return F.transform(
        F.filter(matches(text, KINDS[kind]), lambda m: _valid(kind, m["value"])),
        lambda m: F.struct(
            m["start"].alias("start"),
            F.lit(order).alias("order"),
            (m["start"] + F.length(m["value"])).alias("end"),
            F.lit(kind).alias("kind"),
            F.concat(F.lit(kind + ":"), _lower(m["value"]) if kind in ("email", "ip") else _digits(m["value"])).alias("entity"),
            F.xxhash64(F.right(m["before"], F.lit(REACH)), F.left(m["after"], F.lit(REACH))).alias("context"),
        ),
    )


def _joined(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def find(docs: DataFrame, *carried: str) -> DataFrame:
    """Base spans of every row, written out: carried columns, ``row``, counts per kind, ``entities`` and, where there
    are some, the text as ``_text``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*carried, text.alias("_text")).withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumns({f"_{k}": _entities(F.col("_text"), k, i) for i, k in enumerate(KINDS)})
    found = rows.select(
        *carried,
        "row",
        *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.array_sort(F.concat(*[F.col(f"_{k}") for k in KINDS])).alias("entities"),
        F.when(F.greatest(*[F.size(f"_{k}") for k in KINDS]) > 0, F.col("_text")).alias("_text"),
    )
    return materialize(found, "private-found")


def stem(term: Column) -> Column:
    """The generalised form of a term; null where it would be the term itself."""
    return F.when(F.length(term) > STEM, F.concat(F.left(term, F.lit(STEM)), F.lit("*")))


def _terms(text: Column) -> Column:
    """The terms of a text in their order."""
    return F.regexp_extract_all(_lower(text), F.lit(_TERM), F.lit(0))


def holders(found: DataFrame) -> DataFrame:
    """Rows with each entity that has enough contexts, and is not in every row: ``row, entity, contexts, holders, n``.

    No pair has more contexts than its entity, so the other entities cannot be disclosed. Of a row's contexts
    ``MIN_CONTEXTS`` are kept, which are enough by themselves.
    """
    held = found.select("row", F.explode("entities").alias("e")).groupBy("row", F.col("e.entity").alias("entity"))
    held = held.agg(F.slice(F.array_sort(F.collect_set("e.context")), 1, MIN_CONTEXTS).alias("contexts"))
    each = held.select("entity", F.posexplode("contexts").alias("place", "context")).groupBy("entity").agg(
        F.sum((F.col("place") == 0).cast("long")).alias("holders"), F.count_distinct("context").alias("contexts")
    )
    total = found.agg(F.count(F.lit(1)).alias("n"))
    shared = each.where(F.col("contexts") >= MIN_CONTEXTS).drop("contexts").crossJoin(F.broadcast(total)).where("holders < n")
    return materialize(held.join(materialize(shared, "private-shared"), "entity"), "private-held")


def _marked_as(outside: int) -> Callable[[Column], Column]:
    return lambda term: F.struct(term.alias("term"), F.lit(outside).alias("outside"))


def row_forms(found: DataFrame, held: DataFrame) -> DataFrame:
    """Each form in a row beside each entity of it: ``row, entity, holders, n, form, seen``.

    ``seen`` holds a context of the entity for every occurrence of the form, as far as there are. A form inside
    an address is no evidence on addresses, which are masked.
    """
    texts = found.where("_text is not null").join(held.select("row").distinct(), "row", "left_semi")
    masked = F.regexp_replace("_text", KINDS["email"], " ")
    marked = [F.transform(_terms(t), _marked_as(outside)) for outside, t in enumerate((F.col("_text"), masked))]
    terms = texts.select("row", F.inline(F.concat(*marked))).groupBy("row", "term", "outside").agg(F.count(F.lit(1)).alias("n_terms"))
    forms = terms.withColumn("form", F.explode(F.array_compact(F.array("term", stem(F.col("term")))))).groupBy("row", "form", "outside")
    forms = materialize(forms.agg(F.least(F.sum("n_terms"), F.lit(MIN_CONTEXTS)).cast("int").alias("times")), "private-forms")
    address = F.col("entity").startswith("email:").cast("int")
    return held.withColumn("outside", address).join(forms, ["row", "outside"]).select(
        "row", "entity", "holders", "n", "form", F.slice("contexts", F.lit(1), F.col("times")).alias("seen")
    )


def disclosures(docs: DataFrame, held: DataFrame, near: DataFrame) -> DataFrame:
    """Entity and term pairs above the threshold: ``entity, term, form``; no form means that the term goes.

    Shares are of rows. Only pairs with enough contexts are looked up, so the last joins are as large as the
    evidence. The corpus count folds every row's distinct forms in its task; it is written before it is joined, since
    a join below the fold would move every occurrence.
    """
    forms = near.select("entity", "form", F.posexplode("seen").alias("place", "context"))
    pairs = forms.groupBy("entity", "form").agg(
        F.sum((F.col("place") == 0).cast("long")).alias("both"), F.count_distinct("context").alias("contexts")
    )
    pairs = materialize(pairs.where(F.col("contexts") >= MIN_CONTEXTS), "private-pairs")

    distinct = docs.select(F.array_distinct(_terms(F.col("text"))).alias("t"))
    every = distinct.select(F.explode(F.concat("t", F.array_distinct(F.array_compact(F.transform("t", stem))))).alias("form"))
    counts = materialize(every.groupBy("form").agg(F.count(F.lit(1)).alias("rows")), "private-counts")
    shared = held.select("entity", "holders", "n").distinct()

    # PMI / IC = 1 + log p(e | t) / IC(e).
    information = F.log(F.col("n").cast("double") / F.col("holders"))
    reveals = F.log(F.col("both").cast("double") / F.col("rows")) >= (DISCLOSURE - 1) * information
    strong = pairs.join(shared, "entity").join(counts, "form").where(reveals).select("entity", "form")
    strong = materialize(strong, "private-strong")
    whole = strong.where(~F.col("form").endswith("*")).select("entity", F.col("form").alias("term"), stem(F.col("form")).alias("form"))
    wide = strong.where(F.col("form").endswith("*")).withColumn("too_much", F.lit(True))
    return whole.join(wide, ["entity", "form"], "left").select(
        "entity", "term", F.when(F.col("too_much").isNull(), F.col("form")).alias("form")
    )


def added_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Terms to generalise or remove: ``row, added`` with an array of ``start, order, end, kind, form``.

    A term that several entities ask about is removed when one of them needs that.
    """
    held = holders(found)
    near = row_forms(found, held)
    told = materialize(disclosures(docs, held, near), "private-told")
    hits = near.select("row", "entity", F.col("form").alias("term")).join(told, ["entity", "term"]).groupBy("row", "term").agg(
        F.max(F.col("form").isNull()).alias("gone"), F.min("form").alias("form")
    )
    hits = materialize(hits, "private-hits")
    places = F.transform(
        matches(F.col("_text"), _TERM),
        lambda m: F.struct(
            m["start"].alias("start"), (m["start"] + F.length(m["value"])).alias("end"), _lower(m["value"]).alias("term")
        ),
    )
    texts = found.where("_text is not null").join(hits.select("row").distinct(), "row", "left_semi")
    general = ~F.col("gone")
    span = F.struct(
        "start",
        F.when(general, F.lit(len(KINDS))).otherwise(F.lit(len(KINDS) + 1)).alias("order"),
        "end",
        F.when(general, F.lit("general")).otherwise(F.lit("remove")).alias("kind"),
        F.when(general, F.col("form")).otherwise(F.lit("")).alias("form"),
    )
    return texts.select("row", F.inline(places)).join(hits, ["row", "term"]).groupBy("row").agg(F.collect_list(span).alias("added"))


def private_spans(docs: DataFrame, *carried: str) -> DataFrame:
    """Carried columns, counts per kind, ``base`` spans and ``spans`` of every row, the method's among them.

    A term inside a base span is not added again.
    """
    found = find(docs, *carried)
    added = materialize(added_spans(docs, found), "private-added")
    base = F.transform(
        "entities",
        lambda e: F.struct(e["start"], e["order"], e["end"], e["kind"], F.concat(F.lit("<"), F.upper(e["kind"]), F.lit(">")).alias("form")),
    )
    rows = found.drop("_text").withColumn("base", base).join(added, "row", "left")
    new = F.filter(
        F.coalesce("added", F.array().cast(added.schema["added"].dataType)),
        lambda a: ~F.exists("base", lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"])),
    )
    spans = F.array_sort(F.concat("base", new)).alias("spans")
    return rows.select("row", *carried, *[f"n_{k}" for k in KINDS], "base", spans)


def digests(spans: DataFrame, *carried: str) -> DataFrame:
    """Counts per kind, the digest of the base spans and all spans as text."""
    return spans.select(
        *carried, *[f"n_{k}" for k in KINDS], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans")
    )


def sanitised(docs: DataFrame, *carried: str) -> DataFrame:
    """Carried columns and ``text`` with entities masked by their kind, terms generalised or removed.

    Of overlapping spans the first is replaced and the rest of the others goes with it.
    """
    spans = private_spans(docs, *carried, "text")
    chars = F.split(F.coalesce("text", F.lit("")), "")
    reached = F.transform("spans", lambda s, i: F.struct(s["start"], s["end"], s["form"], i.alias("i")))
    ends = F.transform(
        reached,
        lambda s: F.when(s["i"] == 0, F.lit(0)).otherwise(F.array_max(F.transform(F.slice("spans", F.lit(1), s["i"]), lambda x: x["end"]))),
    )
    parts = F.transform(
        F.arrays_zip(reached.alias("s"), ends.alias("b")),
        lambda z: F.concat(
            F.array_join(F.slice(chars, z["b"] + 1, F.greatest(z["s"]["start"] - z["b"], F.lit(0))), ""),
            F.when(z["s"]["start"] >= z["b"], z["s"]["form"]).otherwise(F.lit("")),
        ),
    )
    last = F.coalesce(F.array_max(F.transform("spans", lambda s: s["end"])), F.lit(0))
    rest = F.array_join(F.slice(chars, last + 1, F.greatest(F.size(chars) - last, F.lit(0))), "")
    return spans.select(*carried, F.concat(F.array_join(parts, ""), rest).alias("text"))
