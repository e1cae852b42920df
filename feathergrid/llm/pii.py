"""Personal data: pattern spans, and terms that reveal them, in DataFrame operations only.

Base spans are emails, IP addresses, payment cards and phone numbers.  Each
distinct value is a protected entity.  Information theory then says which other
terms give an entity away: over the lines of the whole corpus,

    IC(e) = -ln p(e),   PMI(e; t) = ln p(e, t) / (p(e) p(t)),

and a term stands for the share PMI / IC of the entity's information: 1 if it
never occurs without the entity.  A term stands with an entity if it is in the
text just before or after it on its line, so each term of a line counts for two
entities at most.  Terms that disclose ``DISCLOSURE`` or more and were seen with
the entity in ``SUPPORT`` different lines are spans too, and are generalised to
what kind of word they are: ``everywhere`` in every document that holds them,
as they reveal the entity alone, else in the documents where they stand with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, written

#: Share of an entity's information from which a term is treated like the entity.
DISCLOSURE = 0.9
#: Different lines in which a term must stand with an entity.
SUPPORT = 2
#: Up to this many candidate terms are sent to all executors; more are joined by a shuffle.
SMALL_TERMS = 100_000

KINDS = ("email", "ip", "card", "phone")

# The contract's patterns, each written so that no long run of characters is
# scanned from each of its characters: a match begins at a run's first
# character or where the last match ended, and what is taken is not given back.
# For cards the number of digits is part of the pattern, as the chain of digits
# is the longest one either way.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_TERM = r"\p{L}{3,}"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether the digits pass the Luhn test."""
    digits = F.reverse(_digits(value))
    places = F.sequence(F.lit(1), F.length(digits))

    def worth(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.transform(places, worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """Whether a match of the pattern counts."""
    if kind == "ip":
        return value.rlike(f"^{_BYTE}(?:\\.{_BYTE}){{3}}$")
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def entity(kind: Column, value: Column) -> Column:
    """The protected value however it is written: digits only, or lowercase."""
    return F.concat(kind, F.lit(":"), F.when(kind.isin("card", "phone"), _digits(value)).otherwise(F.lower(value)))


_SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def matches(kind: str, text: Column, pattern: Column) -> Column:
    """All matches as ``kind, start, end, value``: places follow from the lengths of matches and of the gaps between them."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    pairs = F.arrays_zip(F.split(text, pattern, F.lit(-1)).alias("gap"), found.alias("hit"))

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["hit"].alias("value"))
        return F.struct(end.alias("at"), F.concat(done["spans"], F.array(span)).alias("spans"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("spans"))
    return F.aggregate(F.filter(pairs, lambda x: x["hit"].isNotNull()), none, step, lambda done: done["spans"])


def base_spans(text: Column) -> Column:
    """Valid spans of all kinds, by kind as listed and then by start."""
    return F.concat(*[_base_spans_of(kind, text) for kind in KINDS])


def _base_spans_of(kind: str, text: Column) -> Column:
    spans = F.filter(matches(kind, text, F.lit(PATTERNS[kind])), lambda s: valid(kind, s["value"]))
    hint = text.contains(_HINTS[kind]) if _HINTS[kind] else text.rlike("[0-9](?:[ -]?[0-9]){12}")
    return F.when(hint, spans).otherwise(F.array().cast(_SPAN))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(_TERM), F.lit(0)))


def _standing_with(found: DataFrame) -> DataFrame:
    """``row, at, line, entity, term`` for the terms beside each entity: the line's place in its text, and its hash."""
    any_kind = "|".join(f"(?:{PATTERNS[k]})" for k in KINDS)
    lines = found.select("row", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    gaps, hits = F.split("line", F.lit(any_kind), F.lit(-1)), F.regexp_extract_all("line", F.lit(any_kind), F.lit(0))
    lines = lines.select("row", "at", F.xxhash64("line").alias("line"), gaps.alias("gaps"), hits.alias("hits")).where(F.size("hits") > 0)
    one = lines.select("row", "at", "line", "gaps", F.posexplode("hits").alias("i", "value"))
    one = one.withColumn("beside", F.concat_ws("\n", F.col("gaps")[F.col("i")], F.col("gaps")[F.col("i") + 1])).drop("gaps", "i")
    kind = F.when(F.col("value").contains("@"), "email").when(F.col("value").startswith("+"), "phone")
    kind = kind.when(F.col("value").rlike(f"^{PATTERNS['ip']}$"), "ip").otherwise("card")
    one = one.withColumn("kind", kind)
    right = F.lit(False)
    for k in KINDS:
        right |= (F.col("kind") == k) & valid(k, F.col("value"))
    one = one.where(right).select("row", "at", "line", entity(F.col("kind"), F.col("value")).alias("entity"), "beside")
    return one.select("row", "at", "line", "entity", F.explode_outer(_terms(F.col("beside"))).alias("term"))


def disclosing_terms(documents: DataFrame, beside: DataFrame) -> DataFrame:
    """``entity, term, disclosure`` of the terms that reveal an entity.

    ``beside`` is what stands with entities; lines, and lines with each
    candidate term, are counted over all ``documents``.  A line counts as often
    as it stands, on all sides; only ``support`` counts different texts of lines.
    """
    seen = written(beside.groupBy("entity", "term").agg(F.count_distinct("row", "at").alias("n_both"), F.count_distinct("line").alias("support")), "pairs")
    alone = beside.groupBy("entity").agg(F.count_distinct("row", "at").alias("n_entity"))
    pairs = seen.where((F.col("support") >= SUPPORT) & F.col("term").isNotNull())
    candidates = written(pairs.select("term").distinct(), "candidates")
    few = candidates.count() <= SMALL_TERMS
    lines = documents.select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    total = documents.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long")).alias("n"))
    words = lines.select(F.explode(_terms(F.col("line"))).alias("term"))
    if few:
        words = words.join(F.broadcast(candidates), "term", "left_semi")
    counts = words.groupBy("term").agg(F.count("*").alias("n_term"))
    counted = written(pairs.join(counts, "term").join(alone, "entity"), "counted")
    n = float(total.first()["n"] or 1)
    information = F.log(F.lit(n) / F.col("n_entity"))
    shared = F.log(F.col("n_both") * F.lit(n) / (F.col("n_entity") * F.col("n_term")))
    share = F.when(information > 0, shared / information).otherwise(F.lit(0.0))
    return counted.select("entity", "term", share.alias("disclosure")).where(F.col("disclosure") >= DISCLOSURE)


def _words_beside(beside: DataFrame, disclosing: DataFrame) -> DataFrame:
    """``row, term`` of the disclosing terms where they stand with their entity."""
    return beside.join(disclosing.select("entity", "term"), ["entity", "term"]).select("row", "term")


def _words_held(texts: DataFrame, disclosing: DataFrame) -> DataFrame:
    """``row, term`` of the disclosing terms in every document that holds them."""
    words = written(disclosing.select("term").distinct(), "disclosing-terms")
    side = F.broadcast(words) if words.count() <= SMALL_TERMS else words
    return texts.select("row", F.explode(_terms(F.col("text"))).alias("term")).join(side, "term", "left_semi")


def find(documents: DataFrame, everywhere: bool = False) -> DataFrame:
    """``row, doc_id, text, base, terms`` per document: its spans, and its text if it has any.

    ``text`` must be the column to search and ``doc_id`` the id.  Null texts
    count as empty.  ``base`` holds the pattern spans by kind and start,
    ``terms`` the spans of disclosing terms by start; both in code points, end
    exclusive.  Terms are marked ``everywhere``, or only in documents where they
    stand with the entity.  ``row`` is the row's place in the table, which must
    read the same each time.
    """
    whole = F.coalesce("text", F.lit(""))
    base = documents.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", whole.alias("text"), base_spans(whole).alias("base")
    )
    base = written(base.withColumn("text", F.when(F.size("base") > 0, F.col("text"))), "base-spans")
    found = base.where("text IS NOT NULL")
    beside = written(_standing_with(found), "beside")
    disclosing = written(disclosing_terms(documents, beside), "disclosing")
    texts = documents.select(F.monotonically_increasing_id().alias("row"), whole.alias("text"))
    rows = _words_held(texts, disclosing) if everywhere else _words_beside(beside, disclosing)
    rows = written(rows.groupBy("row").agg(F.array_sort(F.collect_set("term")).alias("words")), "term-rows")
    # Terms hold letters only, so the alternatives need no quoting.
    pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join("words", "|"), F.lit(r")(?!\p{L})"))
    spans = base.select("row", "base")
    marked = (texts if everywhere else found.select("row", "text")).join(rows, "row").join(spans, "row").withColumn("pattern", pattern)
    outside = F.filter(
        matches("term", F.col("text"), F.col("pattern")),
        lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )
    marked = marked.select("row", F.col("text").alias("with_terms"), outside.alias("terms")).where(F.size("terms") > 0)
    placed = base.join(written(marked, "term-spans"), "row", "left")
    return placed.select("row", "doc_id", F.coalesce("text", "with_terms").alias("text"), "base", F.coalesce("terms", F.array().cast(_SPAN)).alias("terms"))


def _is(kind: str):
    return lambda x: x == kind


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(documents: DataFrame, everywhere: bool = False) -> DataFrame:
    """``doc_id``, the number of spans of each base kind, a digest of the base spans, and all spans as text."""
    found = find(documents, everywhere)
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.concat("base", "terms")).alias("spans")
    )


def _clean(text: Column, spans: Column) -> Column:
    """The text with each span replaced; of overlapping spans the first, and at one start the longest."""
    spans = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"), s["value"].alias("value"))))

    def label(s: Column) -> Column:
        word = F.when(s["value"].rlike(r"^\p{Lu}"), F.lit("[Word]")).otherwise(F.lit("[word]"))
        return F.when(s["kind"] == "term", word).otherwise(F.concat(F.lit("["), s["kind"], F.lit("]")))

    def step(done: Column, s: Column) -> Column:
        gap = F.substring(text, done["at"] + 1, s["start"] - done["at"])
        fresh = F.struct((-s["back"]).alias("at"), F.concat(done["out"], F.array(gap, label(s))).alias("out"))
        return F.when(s["start"] >= done["at"], fresh).otherwise(done)

    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    end = F.lit((1 << 31) - 1)
    return F.aggregate(spans, none, step, lambda done: F.concat(F.array_join(done["out"], ""), F.substring(text, done["at"] + 1, end)))


def sanitise(documents: DataFrame, everywhere: bool = False) -> DataFrame:
    """``documents`` with personal data in ``text`` replaced by its kind, disclosing terms by their kind of word.

    All other columns stay, but ``n_chars``, if there is one, follows the text
    where it changed.  Texts without personal data, null ones too, are unchanged.
    """
    changed = find(documents, everywhere).where("text IS NOT NULL").select("row", _clean(F.col("text"), F.concat("base", "terms")).alias("cleaned"))
    row, cleaned = fresh_name(documents, "row"), fresh_name(documents, "cleaned")
    changed = changed.select(F.col("row").alias(row), F.col("cleaned").alias(cleaned))
    placed = documents.withColumn(row, F.monotonically_increasing_id()).join(written(changed, "cleaned"), row, "left")
    out = []
    for c in documents.columns:
        if c == "text":
            out.append(F.coalesce(cleaned, "text").alias(c))
        elif c == "n_chars":
            out.append(F.coalesce(F.length(cleaned).cast(documents.schema[c].dataType), c).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return placed.select(*out)
