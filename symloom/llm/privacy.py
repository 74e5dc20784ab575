"""Personal data by patterns, and information-theoretic sanitisation of the terms around it.

Built from DataFrame functions alone. Base spans (email, ip, card, phone) come
from patterns and checks. Every value found is a protected entity ``e``. The
words within ``CONTEXT`` characters of its spans are its candidate terms
``t``; over all documents of the corpus,

    IC(e)     = log2(N / n(e))                       bits that e carries
    PMI(t; e) = log2(N * n(t, e) / (n(t) * n(e)))    bits of e that t reveals

with n counting documents. Every pair is scored, also one that a single
document holds. A term that reveals at least ``DISCLOSURE`` of e's bits exceeds
the threshold: near e it is removed where it reveals all of them, and
generalised to its kind otherwise. Documents without an entity are never changed.

Null counts as an empty text: no spans. Repeated rows get the same spans each
and count each in n; the same id on different texts is kept apart. Spans of a
kind are leftmost and do not overlap; spans of different kinds may. Extra
columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import broadcast_if_small, documents, stash

KINDS = ("email", "ip", "card", "phone")
CONTEXT, DISCLOSURE = 64, 0.75
WORD = r"[\p{L}\p{N}]{3,}"

# Each pattern matches what its plain form in the contract matches. Look-behinds keep a failed run from being
# tried again at each of its characters; \G lets a match begin right after the one before. Repeated groups are
# possessive, which changes no match here, as what follows a group never begins within it: a repeated group that
# can give back is matched by recursion, and a long run of digits or of parts of an address ends the stack.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINTS = {"email": "@", "phone": "+"}


def _luhn(digits: Column) -> Column:
    turned = F.reverse(F.left(digits, F.lit(19)))

    def add(total: Column, i: Column) -> Column:
        d = turned.substr(i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


SPAN = "array<struct<start:bigint,end:bigint,value:string>>"


#: Matches that one step of the fold over a text's matches takes, so that its arrays are copied once a block, not once a match.
BLOCK = 128


def _places(text: Column, pattern: str) -> Column:
    """Matches of a pattern with code-point places: what stands between matches has known lengths."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["value"])
        one = F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), pair["value"].alias("value"))
        return F.struct(end.cast("long").alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    pairs = F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("gap"), found.alias("value"))

    def block(acc: Column, k: Column) -> Column:
        done = F.aggregate(F.slice(acc["pairs"], k * BLOCK + 1, F.lit(BLOCK)), F.struct(acc["at"].alias("at"), F.array().cast(SPAN).alias("out")), step)
        return F.struct(acc["pairs"].alias("pairs"), done["at"].alias("at"), F.concat(acc["out"], F.array(done["out"])).alias("out"))

    first = F.struct(pairs.alias("pairs"), F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
    blocks = F.aggregate(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int")), first, block)["out"]
    few = F.aggregate(pairs, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("out")), step)["out"]
    return F.when(F.size(found) == 0, F.array().cast(SPAN)).when(F.size(found) <= BLOCK, few).otherwise(F.flatten(blocks))


def base_spans(kind: str, text: Column) -> Column:
    places = F.filter(_places(text, PATTERNS[kind]), lambda s: _holds(kind, s["value"]))
    return F.when(F.contains(text, F.lit(HINTS[kind])), places).otherwise(F.array().cast(SPAN)) if kind in HINTS else places


def with_base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, key, and an array of spans for each kind); ``key`` tells texts of one id apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key"))
    return rows.select("*", *(base_spans(k, F.col("text")).alias(k) for k in KINDS))


def _context_terms(text: Column, span: Column) -> Column:
    """Whole words within CONTEXT characters on both sides of a span, with their places in the text."""
    left_at = F.greatest(span["start"] - CONTEXT, F.lit(0))
    left = text.substr((left_at + 1).cast("int"), (span["start"] - left_at).cast("int"))
    right = text.substr((span["end"] + 1).cast("int"), F.lit(CONTEXT))
    before = F.filter(_places(left, WORD), lambda w: (w["start"] > 0) | (left_at == 0))
    after = F.filter(_places(right, WORD), lambda w: (w["end"] < CONTEXT))

    def moved(words: Column, by: Column) -> Column:
        return F.transform(words, lambda w: F.struct((w["start"] + by).alias("start"), (w["end"] + by).alias("end"), F.lower(w["value"]).alias("value")))

    return F.concat(moved(before, left_at), moved(after, span["end"]))


def disclosing_terms(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, start, end, removed) of the terms over the threshold; ``found``: rows with spans, as stashed."""
    def entities_of(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(F.concat(F.lit(f"{kind}:"), F.lower(s["value"])).alias("entity"), s["start"].alias("start"), s["end"].alias("end")))

    entity = F.explode(F.concat(*map(entities_of, KINDS)))
    near = found.select("doc_id", "key", "text", entity.alias("s"))
    near = near.select("doc_id", "key", F.col("s.entity").alias("entity"), F.explode(_context_terms(F.col("text"), F.col("s"))).alias("w"))
    near = stash(near.select("doc_id", "key", "entity", F.col("w.value").alias("term"), F.col("w.start").alias("start"), F.col("w.end").alias("end")).filter(~F.col("term").rlike("^[0-9]+$")))

    seen = near.select("doc_id", "key", "entity", "term").distinct()
    together = seen.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both"))
    entities = near.select("doc_id", "key", "entity").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    pairs = stash(together.join(entities, "entity"))

    # Documents of each candidate term, over the whole corpus.
    terms = broadcast_if_small(stash(pairs.select("term").distinct()), 64)
    words = F.array_distinct(F.split(F.lower(F.col(text_col)), r"[^\p{L}\p{N}]+"))
    spread = docs.select(F.explode(words).alias("term")).join(terms, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    n = docs.count()
    ic = F.log2(F.lit(float(max(n, 1))) / F.col("n_entity"))
    pmi = F.log2(F.lit(float(max(n, 1))) * F.col("n_both") / (F.col("n_entity") * F.greatest("n_term", "n_both")))
    over = pairs.join(spread, "term").filter((ic > 0) & (pmi >= DISCLOSURE * ic)).select("entity", "term", (pmi >= ic).alias("removed"))
    return near.join(over, ["entity", "term"]).groupBy("doc_id", "key", "start", "end").agg(F.max("removed").alias("removed"))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Every row of ``docs``: doc_id, text, the spans of each kind, and ``term``: spans the method adds.

    ``carry``: also ``row``, a struct of the other columns, and ``original``, the text as it came (null kept).
    """
    rows = with_base_spans(docs, id_col, text_col)
    some = F.size("email") + F.size("ip") + F.size("card") + F.size("phone") > 0
    found = stash(rows.filter(some))
    terms = disclosing_terms(docs, found, id_col, text_col)
    per_row = terms.groupBy("doc_id", "key").agg(F.sort_array(F.collect_list(F.struct("start", "end", "removed"))).alias("term"))
    kept = found.select("doc_id", "key", *KINDS).distinct()
    spans = kept.alias("k").join(per_row.alias("t"), F.col("k.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("k.key") == F.col("t.key")), "left").select("k.*", "t.term")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rest = [F.struct(*(F.col(c) for c in docs.columns if c != text_col)).alias("row"), F.col(text_col).alias("original")] if carry else []
    all_rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key"), *rest)
    joined = all_rows.alias("d").join(spans.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.key") == F.col("s.key")), "left")
    empty = F.array().cast(SPAN)
    return joined.select("d.doc_id", "d.text", *(["d.row", "d.original"] if carry else []), *(F.coalesce(f"s.{k}", empty).alias(k) for k in KINDS), F.coalesce("s.term", F.array().cast("array<struct<start:bigint,end:bigint,removed:boolean>>")).alias("term"))


def _listed(kind: str) -> Column:
    return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def sanitised(found: DataFrame) -> Column:
    """The text of ``personal_data`` rows with base spans named by kind and disclosing terms generalised or removed."""
    def replaced(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{kind.upper()}]").alias("by")))

    plain = [replaced(k) for k in KINDS]
    terms = F.transform("term", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["removed"], F.lit("")).otherwise(F.lit("[TERM]")).alias("by")))
    # Base spans come first among those that start together: they are the longer part of what has to go.
    spans = F.array_sort(F.concat(*plain, terms), lambda a, b: F.when(a["start"] != b["start"], (a["start"] - b["start"]).cast("int")).otherwise((b["end"] - a["end"]).cast("int")))
    text = F.col("text")

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = text.substr((acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        out = F.when(fresh, F.concat(acc["out"], F.array(F.concat(gap, s["by"])))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(spans, first, step)
    rest = text.substr((done["at"] + 1).cast("int"), F.length(text))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(done["out"], ""), rest)).otherwise(text)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(documents(spark, sf_dir))
    base = F.concat(*(_listed(k) for k in KINDS))
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(base, _listed("term")), ",").alias("spans"),
        F.size("term").cast("long").alias("n_term"),
        (F.size(base) > 0).alias("has_personal_data"),
    )
