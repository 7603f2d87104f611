"""Language identification by Bayesian evidence fusion.

Text likelihoods are multinomial models over hashed character trigrams, counted for every declared language over all
rows by a grouped aggregation; a text weighs as much as ``WEIGHT`` trigrams at most, so that no very long one becomes
its language. A first reading by text alone gives the counts behind the other evidence: how often a
language declares which markup language, how often it stands under which address suffix, and which languages a host
publishes. Host priors are smoothed towards their suffix, suffixes towards the whole corpus, so rare hosts borrow from
what lies above them. The posterior adds up the logarithms.

Every declared language is learnt, however few rows declare it; rare ones lean on the smoothed priors. A declaration
counts by its primary subtag (``pt-BR`` is ``pt``) if that has 2 to 8 letters. Beside the posterior, which only compares
the learnt languages, a text must fit. Where its language was learnt from at least ``EVIDENCE`` weighted trigrams, that
language must make it likelier than evenly spread trigrams would, by ``LIFT`` nats a trigram. A language learnt from less
says too little about other texts of its own; there the letters decide, which few texts suffice to learn: the letters of
all declared texts together must make the text likelier than evenly spread bytes. Both are means per trigram or byte, and
a text passes that comes within two standard errors of the bar (``SPREAD`` nats over the root of its number), so it is
rejected on what it is, not on how long it is. What is rejected is noise and scripts that no language was learnt for.

Defined results: null or letterless text has no language (``und``) and is rejected; null declarations, suffixes and
hosts are values of their own ("absent"); a null id is kept; repeated rows are judged alike; an empty table gives an
empty result; other columns are ignored. Without any declared language there is nothing to learn from: all is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import pieces_of, slim, stage, utf8

#: Hashed trigrams; nats that a trigram must gain over evenly spread ones; their spread; bytes of a model.
BUCKETS, LIFT, SPREAD, MODEL = 1 << 14, 0.5, 2.0, 512 << 20
#: Weighted trigrams from which a model is more data than smoothing; the number that stands for the letters of all languages.
EVIDENCE, LETTERS = 0.5 * BUCKETS, -1
#: Trigrams that a text counts for in a model, at most; all of them are counted, with a lower weight.
WEIGHT = 1_000.0
#: A host with 1/LARGE of the rows or more is joined without a shuffle.
LARGE = 64
#: Weight of the text evidence of one trigram (trigrams overlap), and pseudo-counts of the smoothing.
TRIGRAM_WEIGHT, PULL, DOUBT = 0.35, 20.0, 1.0
_FOLD = np.full(256, 32, np.uint8)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[128:] = np.arange(128, 256)


def _trigrams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of each trigram, the row it stands in, and the letters of each row. Trigrams of three blanks count for nothing."""
    n = len(offs) - 1
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(offs))
    folded = _FOLD[data].astype(np.uint32)
    letters = np.bincount(row, weights=folded != 32, minlength=n)
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), letters
    code = folded[:-2] << np.uint32(16) | folded[1:-1] << np.uint32(8) | folded[2:]
    keep = (row[2:] == row[:-2]) & (code != 0x202020)
    bucket = (code[keep] * np.uint32(0x9E3779B1)) >> np.uint32(18)
    return bucket.astype(np.int64), row[2:][keep], letters


def _counts(languages: list[str]):
    """Trigram counts by declared language, and counts of letters, added up within the task."""
    index = {name: k for k, name in enumerate(languages)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, letters = np.zeros((len(languages), BUCKETS)), np.zeros(256)
        for batch in pieces_of(batches):
            data, offs = utf8(batch.column(1))
            bucket, row, _ = _trigrams(data, offs)
            known = np.array([x in index for x in batch.column(0).to_pylist()])
            size = np.diff(offs)
            letters += np.bincount(_FOLD[data], np.repeat(known * np.minimum(1.0, WEIGHT / np.maximum(size, 1)), size), 256)
            lang = np.array([index.get(x, -1) for x in batch.column(0).to_pylist()])[row]
            weight = np.minimum(1.0, WEIGHT / np.maximum(np.bincount(row, minlength=batch.num_rows), 1))[row]
            ok = lang >= 0
            total += np.bincount(lang[ok] * BUCKETS + bucket[ok], weight[ok], total.size).reshape(total.shape)
        lang, bucket = np.nonzero(total)
        seen = np.flatnonzero(letters)
        n = np.concatenate([total[lang, bucket], letters[seen]])
        lang, bucket = np.concatenate([lang, np.full(len(seen), LETTERS)]), np.concatenate([bucket, seen])
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(n)], names=["lang", "bucket", "n"])

    return run


def _read(shared, weight: float):
    """The log-likelihood of each text under each language, its letters and how well they fit. Columns: key columns, then text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, alphabet = shared.value
        for batch in pieces_of(batches):
            data, offs = utf8(batch.column(batch.schema.get_field_index("text")))
            bucket, row, letters = _trigrams(data, offs)
            gain = np.bincount(np.repeat(np.arange(batch.num_rows), np.diff(offs)), alphabet[_FOLD[data]], batch.num_rows) / np.maximum(letters, 1)
            score = np.stack([np.bincount(row, weights=own[bucket], minlength=batch.num_rows) for own in model], 1) * weight
            listed = pa.FixedSizeListArray.from_arrays(pa.array(score.ravel()), len(model)).cast(pa.list_(pa.float64()))
            many = np.bincount(row, minlength=batch.num_rows)
            keys = [c for c, name in zip(batch.columns, batch.schema.names) if name != "text"]
            names = [name for name in batch.schema.names if name != "text"]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(letters.astype(np.int64)), pa.array(many.astype(np.int64)), pa.array(gain), listed], names=[*names, "letters", "trigrams", "spelt", "heard"])

    return run


def _best(scores: str, languages: list[str]) -> Column:
    """The position of the greatest score; the first of equals."""
    return F.array_position(F.col(scores), F.array_max(scores)).cast("int") - 1


def _shares(read: DataFrame, by: str, languages: list[str]) -> DataFrame:
    """How many rows of each value of ``by`` speak each language, by text alone."""
    counts = [F.sum((F.col("first") == k).cast("double")) for k in range(len(languages))]
    return read.where("letters > 0").groupBy(by).agg(F.array(*counts).alias("n"))


def _column_sums(read: DataFrame, languages: list[str]) -> list[float]:
    row = read.where("letters > 0").agg(*[F.sum((F.col("first") == k).cast("double")).alias(f"n{k}") for k in range(len(languages))]).first()
    return [float(x or 0) for x in row]


def _log(values: Column) -> Column:
    return F.transform(values, lambda x: F.log(x))


def _added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def identify(rows: DataFrame, accepted: list[str] | None = None, least_posterior: float = 0.5) -> DataFrame:
    """``rows`` has the columns id, text, declared, suffix, host.

    Gives id, lang, posterior, declared, letters, fit, founded, kept: kept rows have letters, reach ``least_posterior``,
    fit their language and speak an accepted one (null: any that was learnt). ``fit`` is in nats per trigram, above evenly
    spread trigrams; ``founded`` says whether the language rests on enough text for that to count.
    """
    plain = rows.select(
        F.col("id").cast("long").alias("id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.lower(F.regexp_extract(F.trim("declared"), "^([^-_]*)", 1)), F.lit("absent")).alias("declared"),
        *[F.coalesce(F.lower(F.trim(c)), F.lit("absent")).alias(c) for c in ("suffix", "host")],
    )
    tags = plain.where(F.col("declared").rlike("^[a-z]{2,8}$") & ~F.col("declared").isin("absent", "und")).select("declared").distinct()
    most = MODEL // (4 * BUCKETS)
    languages = sorted(x["declared"] for x in tags.limit(most + 1).collect())
    if len(languages) > most:
        raise ValueError(f"more than {most} languages are declared: map the declarations to language tags first")
    if not languages:
        none = (F.lit("und").alias("lang"), F.lit(0.0).alias("posterior"), "declared", F.lit(0).cast("long").alias("letters"), F.lit(0.0).alias("fit"), F.lit(False).alias("founded"), F.lit(False).alias("kept"))
        return plain.select("id", *none)
    k = len(languages)

    partial = plain.select("declared", "text").mapInArrow(slim(_counts(languages)), "lang int, bucket int, n double")
    counted = partial.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS rows a language
    spelt = counted["lang"].to_numpy(int) == LETTERS
    model, alphabet = np.full((k, BUCKETS), 0.5), np.full(256, 0.5)
    model[counted["lang"].to_numpy(int)[~spelt], counted["bucket"].to_numpy(int)[~spelt]] += counted["n"].to_numpy(float)[~spelt]
    alphabet[counted["bucket"].to_numpy(int)[spelt]] += counted["n"].to_numpy(float)[spelt]
    evidence = [float(x) for x in model.sum(1) - 0.5 * BUCKETS]
    # Letters are told from other letters: blanks, and the bytes that folding makes blanks, say nothing.
    folded = np.unique(_FOLD[_FOLD != 32])
    gains = np.zeros(256, np.float64)
    gains[folded] = np.log(alphabet[folded] / alphabet[folded].sum() * len(folded))
    shared = rows.sparkSession.sparkContext.broadcast((np.log(model / model.sum(1, keepdims=True)).astype(np.float32), gains))

    schema = "id long, declared string, suffix string, host string, letters long, trigrams long, spelt double, heard array<double>"
    read = plain.select("id", "declared", "suffix", "host", "text").mapInArrow(slim(_read(shared, TRIGRAM_WEIGHT)), schema)
    read = stage(read.withColumn("first", _best("heard", languages)), "language-read")

    # The corpus, then suffixes pulled towards it, then hosts pulled towards their suffix.
    sums = _column_sums(read, languages)
    world = [(n + 1) / (sum(sums) + k) for n in sums]
    flat = F.array(*[F.lit(x) for x in world])
    suffixes = _shares(read, "suffix", languages)
    suffixes = suffixes.withColumn("suffix_prior", _smoothed("n", flat)).select("suffix", "suffix_prior", F.col("n").alias("suffix_n"))
    hosts = read.where("letters > 0").groupBy("host").agg(
        F.max("suffix").alias("suffix"), F.array(*[F.sum((F.col("first") == i).cast("double")) for i in range(k)]).alias("n"), F.count(F.lit(1)).alias("rows")
    )
    hosts = hosts.join(suffixes.select("suffix", "suffix_prior"), "suffix", "left")
    hosts = stage(hosts.select("host", "rows", _smoothed("n", F.coalesce("suffix_prior", flat)).alias("host_prior")), "language-hosts")
    # How likely each language is to declare a value, or to stand under a suffix.
    declares = _shares(read, "declared", languages).select("declared", _given(F.col("n"), sums).alias("says"))
    stands = suffixes.select("suffix", _given(F.col("suffix_n"), sums).alias("stands"))

    none = F.array(*[F.lit(0.0)] * k)
    fused = _with_host(read, hosts, sum(sums)).join(declares, "declared", "left").join(stands, "suffix", "left")
    total_score = _added(_added(F.col("heard"), _log(F.coalesce("host_prior", flat))), _added(F.coalesce("says", none), F.coalesce("stands", none)))
    fit = (F.array_max("heard") / TRIGRAM_WEIGHT) / F.greatest("trigrams", F.lit(1)) + F.when(F.col("trigrams") > 0, float(np.log(BUCKETS))).otherwise(0.0)
    founded = F.get(F.array(*[F.lit(x >= EVIDENCE) for x in evidence]), _best("heard", languages))
    near = lambda mean, n: mean + 2 * SPREAD / F.sqrt(F.greatest(n, F.lit(1)))
    likely = F.when(founded, near(fit, F.col("trigrams")) >= LIFT).otherwise(near(F.col("spelt"), F.col("letters")) >= 0)
    scored = fused.select("id", "declared", "letters", fit.alias("fit"), founded.alias("founded"), likely.alias("likely"), total_score.alias("score")).withColumn("top", F.array_max("score")).withColumn("at", _best("score", languages))
    sum_exp = F.aggregate(F.transform("score", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, b: a + b)
    named = F.array(*[F.lit(x) for x in languages])
    spoken = F.col("letters") > 0
    out = scored.select(
        "id",
        F.when(spoken, F.get(named, F.col("at"))).otherwise("und").alias("lang"),
        F.when(spoken, 1 / sum_exp).otherwise(0.0).alias("posterior"),
        "declared",
        "letters",
        "fit",
        "founded",
        "likely",
    )
    wanted = F.col("lang").isin(accepted) if accepted is not None else F.lit(True)
    return out.withColumn("kept", (F.col("letters") > 0) & (F.col("posterior") >= least_posterior) & F.col("likely") & wanted).drop("likely")


def _with_host(read: DataFrame, hosts: DataFrame, rows: float) -> DataFrame:
    """Add the prior of its host to each row. The hosts with 1/``LARGE`` of all rows or more, at most ``LARGE`` of them, go
    to every task; their rows take no part in the join of the others but are spread over its tasks."""
    large = hosts.where(F.col("rows") * LARGE >= rows).select("host", F.col("host_prior").alias("__large"))
    small = hosts.where(F.col("rows") * LARGE < rows).select(F.col("host").alias("__host"), F.col("host_prior").alias("__small"))
    met = read.join(F.broadcast(large), "host", "left")
    key = F.when(F.col("__large").isNull(), F.col("host")).otherwise(F.concat(F.lit("\x00"), F.xxhash64("id", "letters", "trigrams").cast("string")))
    joined = met.withColumn("__key", key).join(small, F.col("__key") == F.col("__host"), "left")
    return joined.withColumn("host_prior", F.coalesce("__large", "__small")).drop("__large", "__small", "__host", "__key")


def _smoothed(counts: str, prior: Column) -> Column:
    """Shares of the counts with ``PULL`` rows of the prior added."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, b: a + b) + PULL
    return F.transform(F.zip_with(counts, prior, lambda n, p: n + PULL * p), lambda x: x / total)


def _given(counts: Column, sums: list[float]) -> Column:
    """log P(value | language), with ``DOUBT`` rows of the value added to every language."""
    return F.zip_with(counts, F.array(*[F.lit(s + 2 * DOUBT) for s in sums]), lambda n, s: F.log((n + DOUBT) / s))


def documents_evidence(docs: DataFrame) -> DataFrame:
    """Documents declare a language in ``lang`` and name their host in ``source``; they have no address."""
    return docs.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col("source").alias("host"))


def pages_evidence(pages: DataFrame) -> DataFrame:
    """Pages declare a language in their markup; suffix and host come from the address. What is left open ends with the page."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1))
    marked = F.regexp_extract("html", r"(?i)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z]+)", 1)
    visible = F.regexp_replace("html", r"(?is)<(script|style)\b.*?(?:</\1\s*>|\z)|<!--.*?(?:-->|\z)|<[^<>]*>|&[a-zA-Z#0-9]+;", " ")
    return pages.select(F.col("page_id").alias("id"), visible.alias("text"), F.nullif(marked, F.lit("")).alias("declared"), F.nullif(F.regexp_extract(host, r"\.([^.]+)$", 1), F.lit("")).alias("suffix"), F.nullif(host, F.lit("")).alias("host"))


def language_of_documents(docs: DataFrame, accepted: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, lang, posterior, declared, letters, fit, founded, kept."""
    return identify(documents_evidence(docs), accepted).withColumnRenamed("id", "doc_id")


def language_of_pages(pages: DataFrame, accepted: list[str] | None = None) -> DataFrame:
    """One row per page: page_id, lang, posterior, declared, letters, fit, founded, kept."""
    return identify(pages_evidence(pages), accepted).withColumnRenamed("id", "page_id")
