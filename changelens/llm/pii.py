"""Personal data: base patterns, and terms that reveal what the patterns protect, with DataFrame functions only.

Emails, addresses, card and phone numbers are found by pattern. Which other words disclose such an
entity is estimated from the corpus: a term's pointwise mutual information with the entity, over
the entity's own information, tells how much of it the term gives away. Terms above the threshold
are marked in the documents that hold the entity, and are generalised or removed with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.llm.common import lower_ascii, stored, words_of
from changelens.operators.barrier import bind, prefix_sum
from changelens.operators.joins import salted_lookup

_LOCAL = "[A-Za-z0-9._%+-]"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
# Each finds the leftmost matches of its plain form without trying every start within a run again.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "term"]
TERM = r"\p{L}{3,}"
# A text without this character has no match.
NEEDS = {"email": "@", "phone": "+", "ip": "."}

# Terms on either side of an entity that make its context.
CONTEXT = 5
# A term discloses an entity from this share of the entity's information on; this much evidence is needed.
DISCLOSURE = 0.8
LEAST_CONTEXTS = 3


def digits_of(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check sum of a string of digits holds."""

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda acc, d: acc + F.coalesce(d, F.lit(0))) % 10 == 0


def holds(kind: str, found: Column) -> Column:
    """Whether a match is one: parts, number of digits and check sum."""
    if kind == "ip":
        return found.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.length(digits_of(found)).between(12, 19) & luhn(digits_of(found))
    if kind == "phone":
        return F.length(digits_of(found)).between(9, 15)
    return F.lit(True)


def matched(rows: DataFrame, name: str, pattern: str, when: Column) -> DataFrame:
    """Add ``name``: (start, end, found) of the pattern's matches in ``t``, in code points; none where ``when`` fails.

    The text is split at the matches; running sums of the lengths give the places.
    """
    none = F.array().cast("array<string>")
    rows = bind(rows, _m=F.when(when, F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).otherwise(none))
    sizes = F.zip_with(F.slice(F.split("t", pattern), F.lit(1), F.size("_m")), "_m", lambda a, b: F.char_length(a) + F.char_length(b))
    rows = bind(rows, _l=F.when(F.size("_m") > 0, sizes).otherwise(F.array().cast("array<int>")))
    rows = bind(rows, _e=prefix_sum("_l"))
    span = lambda end, m: F.struct((end - F.char_length(m)).cast("bigint").alias("start"), end.cast("bigint").alias("end"), m.alias("found"))
    return bind(rows, **{name: F.zip_with("_e", "_m", span)}).drop("_m", "_l", "_e")


def base_spans(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """(id, digest, spans, terms) of every row.

    spans: (start, ord, end, kind, value), sorted; value is the entity in one form (digits, or lower
    case). terms: (start, end, term) outside the spans, in order, for rows that have a span.
    """
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text], F.lit("")).alias("t"))
    rows = rows.select("id", F.xxhash64("t").alias("digest"), "t")
    for kind, pattern in PATTERNS.items():
        when = F.contains("t", F.lit(NEEDS[kind])) if kind in NEEDS else F.col("t").rlike("[0-9]")
        rows = matched(rows, kind, pattern, when)

    def spans_of(kind: str) -> Column:
        def span(m: Column) -> Column:
            value = lower_ascii(m["found"]) if kind in ("email", "ip") else digits_of(m["found"])
            return F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("ord"), m["end"].alias("end"), F.lit(kind).alias("kind"), value.alias("value"))

        return F.transform(F.filter(kind, lambda m: holds(kind, m["found"])), span)

    rows = bind(rows, spans=F.array_sort(F.concat(*[spans_of(k) for k in PATTERNS]))).drop(*PATTERNS)
    rows = matched(rows, "terms", TERM, F.size("spans") > 0)
    free = F.filter("terms", lambda x: ~F.exists("spans", lambda s: (x["start"] < s["end"]) & (s["start"] < x["end"])))
    terms = F.transform(free, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lower(x["found"]).alias("term")))
    return rows.select("id", "digest", "spans", F.when(F.size("spans") > 0, terms).alias("terms"))


def disclosing_terms(base: DataFrame, docs: DataFrame, text: str, disclosure: float, least_contexts: int) -> DataFrame:
    """(kind, value, term) of the terms that disclose an entity, from the ``base_spans`` of ``docs``.

    p(term), p(entity) and p(term, entity) are shares of the different texts that hold the one, the other
    and both, wherever they stand, so all three are of one distribution and copies count once. What three
    copies with small changes share is no evidence: an entity needs ``least_contexts`` different contexts,
    ``CONTEXT`` terms on either side, and a term as many texts with it. An entity of every text has no
    information to give away.
    """
    entity = ["kind", "value"]
    total = float(max(base.select("digest").distinct().count(), 1))
    found = stored(base.filter(F.size("spans") > 0).select("digest", "spans", "terms").dropDuplicates(["digest"]))
    met = found.select("terms", F.explode("spans").alias("s"))
    before = F.slice(F.reverse(F.filter("terms", lambda x: x["end"] <= F.col("s.start"))), F.lit(1), F.lit(CONTEXT))
    after = F.slice(F.filter("terms", lambda x: x["start"] >= F.col("s.end")), F.lit(1), F.lit(CONTEXT))
    around = F.transform(F.concat(F.reverse(before), after), lambda x: x["term"])
    contexts = met.select("s.kind", "s.value", F.xxhash64(around).alias("around")).distinct().groupBy(*entity).agg(F.count(F.lit(1)).alias("contexts"))
    distinct_entities = F.array_distinct(F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["value"].alias("value"))))
    held_entities = found.select("digest", F.explode(distinct_entities).alias("e")).select("digest", "e.kind", "e.value")
    of_entity = held_entities.groupBy(*entity).agg(F.count(F.lit(1)).alias("with_entity"))
    # mutual >= disclosure * own information, solved for the number of texts with the term.
    share = F.pow(F.lit(total) / F.col("with_entity"), F.lit(1.0 - disclosure))
    of_entity = of_entity.join(contexts.filter(F.col("contexts") >= least_contexts), entity)
    of_entity = of_entity.filter(F.col("with_entity").between(least_contexts, total - 1))
    of_entity = stored(of_entity.select(*entity, share.alias("share"), (F.col("with_entity") * share).alias("most")))
    # A term in more texts than any entity allows, among those with entities alone, discloses none: only the rest are paired.
    ceiling = of_entity.agg(F.max("most")).first()[0] or 0.0
    held_terms = found.select("digest", F.explode(F.array_distinct(F.transform("terms", lambda x: x["term"]))).alias("term"))
    near = held_terms.groupBy("term").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n").between(least_contexts, ceiling))
    near = stored(near)
    # Both lookups are unique by key; a common entity or term is spread by text.
    left = salted_lookup(held_entities, of_entity.drop("most"), entity, ["digest"], "inner")
    right = salted_lookup(held_terms, near, ["term"], ["digest"], "inner")
    both = left.join(right, "digest").groupBy(*entity, "term").agg(F.count(F.lit(1)).alias("both"), F.first("share").alias("share"), F.first("n").alias("n"))
    most = F.col("both") * F.col("share")
    rare = stored(both.filter((F.col("both") >= least_contexts) & (F.col("n") <= most)).select(*entity, "term", most.alias("most")))
    body = F.coalesce(docs[text], F.lit(""))
    plain = F.lower(F.regexp_replace(body, r"[^\p{L}]+", " "))
    held = docs.select(F.xxhash64(body).alias("digest"), F.explode(F.array_distinct(words_of(plain))).alias("term"))
    held = held.join(rare.select("term").distinct(), "term", "left_semi").distinct()
    of_term = held.groupBy("term").agg(F.count(F.lit(1)).alias("with_term"))
    return rare.join(of_term, "term").filter(F.col("with_term") <= F.col("most")).select(*entity, "term")


def personal_data(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", disclosure: float = DISCLOSURE, least_contexts: int = LEAST_CONTEXTS
) -> DataFrame:
    """(id, digest, base, all) of every row: base spans, and base spans with the disclosing terms.

    Spans are (start, ord, end, kind), in code points, end exclusive, sorted by start and kind. A null
    text counts as empty and has none. Repeated rows get equal spans; an empty table gives an empty
    result; other columns are ignored.
    """
    base = stored(base_spans(docs, text, id_col))
    found = base.filter(F.size("spans") > 0)
    telling = stored(disclosing_terms(base, docs, text, disclosure, least_contexts))
    entities = found.select("id", "digest", F.explode("spans").alias("s")).select("id", "digest", "s.kind", "s.value").distinct()
    of_doc = salted_lookup(entities, telling, ["kind", "value"], ["id", "digest"], "inner").groupBy("id", "digest").agg(F.collect_set("term").alias("telling"))
    of_doc = stored(of_doc.select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "telling"))
    span = lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index("term")).alias("ord"), x["end"].alias("end"), F.lit("term").alias("kind"))
    added = F.transform(F.filter("terms", lambda x: F.array_contains("telling", x["term"])), span)
    joined = base.join(of_doc, base["id"].eqNullSafe(of_doc["_id"]) & (base["digest"] == of_doc["_digest"]), "left")
    plain = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end"), s["kind"].alias("kind")))
    every = F.array_sort(F.concat(plain, F.coalesce(added, F.array().cast("array<struct<start:bigint,ord:int,end:bigint,kind:string>>"))))
    return joined.select(F.col("id").alias(id_col), "digest", plain.alias("base"), every.alias("all"))


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def sanitised(docs: DataFrame, text: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with each base span of ``text`` generalised to its kind in brackets, and each disclosing term removed.

    Of overlapping spans the one that starts first counts, and of those the first by kind. A null or
    empty text stays as it is; repeated rows all stay, changed alike; an empty table gives an empty
    result; all columns of ``docs`` are kept, whatever their names.
    """
    spans = personal_data(docs, text, id_col, **options).filter(F.size("all") > 0)
    spans = stored(spans.select(F.col(id_col).alias("_id"), F.col("digest").alias("_digest"), F.col("all").alias("_all")).dropDuplicates(["_id", "_digest"]))
    same = docs[id_col].eqNullSafe(spans["_id"]) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == spans["_digest"])
    joined = docs.join(spans, same, "left")

    def part(start: Column, end: Column) -> Column:
        return F.substring(docs[text], (start + 1).cast("int"), (end - start).cast("int"))

    def step(acc: Column, s: Column) -> Column:
        shown = F.when(s["kind"] == "term", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        moved = F.struct(F.concat(acc["out"], part(acc["at"], s["start"]), shown).alias("out"), s["end"].alias("at"))
        return F.when(s["start"] < acc["at"], acc).otherwise(moved)

    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))
    new = F.aggregate("_all", start, step, lambda acc: F.concat(acc["out"], part(acc["at"], F.char_length(docs[text]).cast("bigint"))))
    names = [F.when(F.col("_all").isNotNull(), new).otherwise(docs[c]).alias(c) if c == text else docs[c] for c in docs.columns]
    return joined.select(*names)
