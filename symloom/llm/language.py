"""Language identification by Bayesian fusion of what text, markup, address and host say.

log P(l | all) = t * log P(text | l) + log P(declared | l) + log P(suffix | l) + log P(l | host) + const

The text likelihood is a byte-trigram model over hashed trigrams. A language
declared in markup and the suffix of an address count with a reliability. Host
priors come from grouped aggregation of the text-only posteriors and are
smoothed hierarchically: host towards its address suffix, suffix towards the
whole corpus; a document's own share is taken out of its host's prior. One more
class, ``und``, has uniform trigrams and stands for what is in no language.
Documents in ``und`` and documents without text are rejected.

Nulls: a null text counts as empty, a null host as the host '', a null or
unknown declared language gives no evidence. Repeated rows are judged alike and
count each in their host's prior; ties go to the first language by name. Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import broadcast_if_small, documents, short_batches, stash, texts_of

#: Rows of the labelled sample that the text model is fitted on: those with the smallest hash of their id.
TRAIN_ROWS = 1500
SLOTS = 1 << 16
#: Share of a language's trigrams that is spread evenly over all slots.
UNSEEN = 0.1
#: Share of the evidence of dependent neighbouring trigrams that counts, weight of ``und``, and reliabilities.
TEMPER, UND_PRIOR, DECLARED_RIGHT, SUFFIX_RIGHT = 0.3, 1e-3, 0.9, 0.7
HOST_WEIGHT, SUFFIX_WEIGHT = 20.0, 100.0
#: Address suffixes (ISO 3166 codes) of countries with one main language of the model.
SUFFIX_LANGUAGE = {"at": "de", "de": "de", "li": "de", "es": "es", "mx": "es", "ar": "es", "fr": "fr", "uk": "en", "us": "en", "au": "en", "nz": "en", "ie": "en"}
MARKUP = r"(?i)<html[^>]*\slang\s*=\s*[\"']?([a-z]{2})"


def trigram_slots(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts, one after another, and where each text's begin, in lower case."""
    data = np.frombuffer(b"".join(b"  " + t.lower() + b" " for t in texts), np.uint8).astype(np.uint32)
    # Capital letters of Latin-1 too: C3 80 to C3 9E, without the multiplication sign.
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    after = after[(data[after] <= 0x9E) & (data[after] != 0x97)]
    data[after] += 0x20
    starts = np.cumsum([0, *(len(t) + 3 for t in texts)])
    codes = data[:-2] << np.uint32(16) | data[1:-1] << np.uint32(8) | data[2:] if len(data) > 2 else data[:0]
    return (codes * np.uint32(2654435761) >> np.uint32(16)).astype(np.int64), starts


class TextModel:
    """log P(trigram | language) by slot, ``und`` last."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        seen = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
        logs = np.log((1 - UNSEEN) * seen + UNSEEN / SLOTS)
        self.table = np.concatenate([logs, np.full((1, SLOTS), -np.log(SLOTS))]).T.copy()

    def score(self, texts: list[bytes]) -> np.ndarray:
        slots, starts = trigram_slots(texts)
        out = np.zeros((len(texts), self.table.shape[1]))
        if len(slots):
            # The two trigrams that reach from one text into the next belong to neither.
            alone = np.ones(len(slots), bool)
            for k in (1, 2):
                at = starts[1:-1] - k
                alone[at[at < len(slots)]] = False
            held = self.table[slots] * alone[:, None]
            out = np.add.reduceat(held, np.minimum(starts[:-1], len(slots) - 1), axis=0)
        return out


def _pieces(texts: list[bytes], limit: int = 1 << 20):
    """Runs of consecutive texts of about ``limit`` bytes."""
    lo = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield texts[lo : k + 1]
            lo, size = k + 1, 0
    if lo < len(texts):
        yield texts[lo:]


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", rows: int = TRAIN_ROWS) -> TextModel:
    """Trigram counts of at most ``rows`` labelled documents; only counts reach the driver."""
    short_batches(labelled.sparkSession)
    usable = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col)).alias("h"))
    # Hashes are chosen first, so that no text is sorted or sent; ``rows`` of them are a bounded broadcast.
    sample = usable.join(F.broadcast(usable.select("h").orderBy("h").limit(rows).distinct()), "h", "left_semi").limit(rows)

    def count(batches):
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist())
            texts = texts_of(batch)
            for lang in sorted(set(langs.tolist())):
                for part in _pieces([texts[k] for k in np.flatnonzero(langs == lang)]):
                    found[lang] = found.get(lang, 0) + np.bincount(trigram_slots(part)[0], minlength=SLOTS)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([v.astype("<i8").tobytes() for v in found.values()], pa.binary())], ["lang", "counts"])

    sums: dict[str, np.ndarray] = {}
    for lang, raw in sample.select("text", "lang").mapInArrow(count, "lang string, counts binary").collect():
        sums[lang] = sums.get(lang, 0) + np.frombuffer(raw, "<i8")
    langs = sorted(sums) or ["und-empty"]
    return TextModel(langs, np.array([sums.get(k, np.zeros(SLOTS)) for k in langs], float))


def _row_key(docs: DataFrame, id_col: str, text_col: str, host_col: str | None) -> Column:
    """A hash of what a row's outcome follows from, besides its id."""
    return F.xxhash64(docs[text_col].cast("string"), docs[host_col].cast("string") if host_col else F.lit(None), F.lit(id_col))


def identify(docs: DataFrame, model: TextModel, id_col: str = "doc_id", text_col: str = "text", host_col: str | None = "source", declared_col: str | None = None, address_col: str | None = None, keyed: bool = False) -> DataFrame:
    """(doc_id, n_bytes, lang, probability, text_lang, declared, suffix, rejected) of every row.

    ``declared_col``: a column of language codes; without one the markup of the text is looked at.
    ``address_col``: a URL whose host and suffix count; without one ``host_col`` names the host.
    ``keyed``: also ``key``, a hash of the text and the host, which tells rows of one id apart.
    """
    short_batches(docs.sparkSession)
    langs = model.langs
    names, share = [f"l{k}" for k in range(len(langs) + 1)], [f"p{k}" for k in range(len(langs))]
    text = F.col(text_col).cast("string")
    address = F.regexp_extract(F.lower(F.coalesce(F.col(address_col), F.lit(""))), r"^[a-z]+://([^/:?#]+)", 1) if address_col else F.lit("")
    host = address if address_col else F.coalesce(F.col(host_col).cast("string"), F.lit("")) if host_col else F.lit("")
    declared = F.lower(F.coalesce(F.col(declared_col), F.lit("")).substr(1, 2)) if declared_col else F.when(F.contains(F.coalesce(text, F.lit("")), F.lit("<")), F.regexp_extract(text, MARKUP, 1)).otherwise("")
    key = _row_key(docs, id_col, text_col, host_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("key"), text.alias("text"), host.alias("host"), F.lower(declared).alias("declared"), F.regexp_extract(host, r"\.([a-z]{2,})$", 1).alias("suffix"))

    def score(batches):
        for batch in batches:
            texts = texts_of(batch)
            parts = [model.score(p) for p in _pieces(texts)]
            s = np.concatenate(parts) if parts else np.zeros((0, len(names)))
            # What the text alone says, as shares of the languages; a text without bytes says nothing.
            p = np.exp(TEMPER * (s[:, :-1] - s[:, :-1].max(axis=1, keepdims=True)))
            p = p / p.sum(axis=1, keepdims=True) * np.array([len(t) > 0 for t in texts], float)[:, None]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), batch.column("host"), batch.column("declared"), batch.column("suffix"), pa.array([len(t) for t in texts], pa.int64()), *(pa.array(s[:, k], pa.float64()) for k in range(len(names))), *(pa.array(p[:, k], pa.float64()) for k in range(len(langs)))], ["doc_id", "key", "host", "declared", "suffix", "n_bytes", *names, *share])

    schema = "doc_id long, key long, host string, declared string, suffix string, n_bytes long, " + ", ".join(f"{n} double" for n in [*names, *share])
    scored = stash(rows.mapInArrow(score, schema))

    # Grouped aggregation, then smoothing downwards: corpus, suffix, host.
    sums = [F.sum(p).alias(p) for p in share]
    hosts = stash(scored.groupBy("suffix", "host").agg(*sums))
    whole = hosts.agg(*(F.sum(p).alias(p) for p in share)).first()
    total = sum(v or 0.0 for v in whole)
    corpus = [((v or 0.0) + 1.0) / (total + len(langs)) for v in whole]
    suffixes = hosts.groupBy("suffix").agg(*(F.sum(p).alias(f"s{k}") for k, p in enumerate(share)))
    of_suffix = functools.reduce(lambda a, b: a + b, [F.col(f"s{k}") for k in range(len(langs))])
    suffixes = suffixes.select("suffix", *(((F.col(f"s{k}") + SUFFIX_WEIGHT * corpus[k]) / (of_suffix + SUFFIX_WEIGHT)).alias(f"s{k}") for k in range(len(langs))))
    priors = hosts.join(suffixes, "suffix").select("suffix", "host", *(F.col(p).alias(f"h{k}") for k, p in enumerate(share)), *(f"s{k}" for k in range(len(langs))))
    priors = broadcast_if_small(stash(priors), 16 * len(langs) + 64)

    known = F.col("n_bytes") > 0
    rest = functools.reduce(lambda a, b: a + b, [F.col(f"h{k}") - F.col(p) for k, p in enumerate(share)])
    evidence = []
    for k, lang in enumerate(langs):
        prior = (F.greatest(F.col(f"h{k}") - F.col(share[k]), F.lit(0.0)) + HOST_WEIGHT * F.col(f"s{k}")) / (F.greatest(rest, F.lit(0.0)) + HOST_WEIGHT)
        suffix_of = [x for x, y in SUFFIX_LANGUAGE.items() if y == lang]
        told = F.col("declared").isin(langs)
        placed = F.col("suffix").isin(sorted(x for x, y in SUFFIX_LANGUAGE.items() if y in langs))
        wrong = max(1, len(langs) - 1)
        evidence.append(
            TEMPER * F.col(f"l{k}")
            + F.when(told & (F.col("declared") == lang), np.log(DECLARED_RIGHT)).when(told, np.log((1 - DECLARED_RIGHT) / wrong)).otherwise(0.0)
            + F.when(placed & F.col("suffix").isin(suffix_of), np.log(SUFFIX_RIGHT)).when(placed, np.log((1 - SUFFIX_RIGHT) / wrong)).otherwise(0.0)
            + F.log(prior)
        )
    evidence.append(TEMPER * F.col(names[-1]) + float(np.log(UND_PRIOR)))
    # Written before the shares are taken: a filter on the outcome would otherwise repeat all of this in its condition.
    fused = stash(scored.join(priors, ["suffix", "host"]).select("doc_id", "key", "n_bytes", "declared", "suffix", *names, *(e.alias(f"e{k}") for k, e in enumerate(evidence))))
    best = F.greatest(*(f"e{k}" for k in range(len(names))))
    lang = F.coalesce(*(F.when(F.col(f"e{k}") == best, F.lit(x)) for k, x in enumerate([*langs, "und"])))
    share_of_best = 1 / functools.reduce(lambda a, b: a + b, [F.exp(F.col(f"e{k}") - best) for k in range(len(names))])
    text_best = F.greatest(*names)
    text_lang = F.coalesce(*(F.when(F.col(n) == text_best, F.lit(x)) for n, x in zip(names, [*langs, "und"], strict=True)))
    out = fused.select("doc_id", "n_bytes", F.when(known, lang).otherwise("und").alias("lang"), F.when(known, share_of_best).otherwise(1.0).alias("probability"), F.when(known, text_lang).otherwise("und").alias("text_lang"), "declared", "suffix", *(["key"] if keyed else []))
    return out.withColumn("rejected", F.col("lang") == "und")


def in_a_language(docs: DataFrame, model: TextModel, id_col: str = "doc_id", text_col: str = "text", host_col: str | None = "source") -> DataFrame:
    """``docs`` without the documents that language identification rejects; rows of one id are judged each."""
    found = identify(docs, model, id_col, text_col, host_col, keyed=True)
    rejected = found.filter("rejected").select(F.col("doc_id").alias("rejected_id"), F.col("key").alias("rejected_key")).distinct()
    same = docs[id_col].cast("long").eqNullSafe(rejected["rejected_id"]) & (_row_key(docs, id_col, text_col, host_col) == rejected["rejected_key"])
    return docs.join(rejected, same, "left_anti")


def page_languages(pages: DataFrame, model: TextModel) -> DataFrame:
    """Language of web pages: visible text, declared markup language, and address."""
    visible = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<!--.*?-->|<[^>]*>", " ")
    rows = pages.select("page_id", "url", visible.alias("text"), F.regexp_extract("html", MARKUP, 1).alias("markup"))
    return identify(rows, model, "page_id", "text", None, "markup", "url").withColumnRenamed("doc_id", "page_id")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, fit(docs)).withColumn("kept", ~F.col("rejected"))


def op6_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every web page, judged by the model of the documents with the evidence that only pages carry."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return page_languages(pages, fit(documents(spark, sf_dir))).withColumn("kept", ~F.col("rejected"))
