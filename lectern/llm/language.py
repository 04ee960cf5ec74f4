"""Language of a text by Bayesian evidence fusion.

Evidence for each language, added as log odds and normalised to a posterior:
* text: naive Bayes over hashed byte 3-grams of letters (``BUCKETS`` cells a language), fitted to at most ``TRAIN_ROWS``
  rows with a declared language (one a language at least), chosen by a hash in each language and counted whole, on the
  executors; the languages are all that some text of the table is declared in; all of the text counts, at
  ``TEXT_WEIGHT`` nats a gram at most (grams of one text depend on one another);
* the declared markup language and the address suffix (a country's top-level domain or a language path part), each
  right with probability ``DECLARED_TRUST`` or ``SUFFIX_TRUST``; a missing or unknown one says nothing;
* the host: its counts of declared languages, smoothed towards its parent domain's, those towards the whole corpus's,
  made by grouped aggregation over all rows (each level a sum of partial counts, so a host with a third of the rows is no
  hot spot) with ``HOST_PRIOR`` and ``PARENT_PRIOR`` pseudo-counts; a row's own declaration is taken out of its host's
  counts, since it is evidence already.

A document is rejected (language ``und``) if its text has no letters, or if no language reaches ``LEAST_POSTERIOR``.  Of
languages with equal scores the first by name counts; of training rows with equal hashes those with the least text.
Null and empty texts, declarations, addresses and hosts are evidence of nothing.  Repeated rows are judged alike; very
long texts are read whole; an empty table gives an empty result; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import map_texts, materialize

TRAIN_ROWS = 4000
BUCKETS = 1 << 14
TEXT_WEIGHT = 0.25
DECLARED_TRUST = 0.9
SUFFIX_TRUST = 0.8
HOST_PRIOR = 5.0
PARENT_PRIOR = 20.0
LEAST_POSTERIOR = 0.5

#: Top-level domains that suggest a language.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "nz": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "ru": "ru", "jp": "ja", "cn": "zh", "se": "sv", "dk": "da", "fi": "fi", "no": "no", "cz": "cs", "tr": "tr", "gr": "el", "kr": "ko"}

#: 0 for bytes that separate letters, ASCII letters in lower case, all others as they are.
_LETTER = np.zeros(256, np.uint32)
_LETTER[128:] = np.arange(128, 256)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)


def gram_cells(text: str) -> np.ndarray:
    """Cells of the byte 3-grams inside runs of letters; a run's edges count as one separator."""
    b = _LETTER[np.frombuffer(b" " + text.encode("utf-8", "surrogatepass") + b" ", np.uint8)]
    a, m, z = b[:-2], b[1:-1], b[2:]
    key = (a * np.uint32(0x9E3779B1)) ^ (m * np.uint32(0x85EBCA6B)) ^ (z * np.uint32(0xC2B2AE35))
    return (key[m > 0] >> np.uint32(7)) & np.uint32(BUCKETS - 1)


class TextModel:
    """log P(gram | language) as a table of cells by languages."""

    def __init__(self, counts: dict[str, np.ndarray]):
        """counts: for each language the number of grams in each cell."""
        self.languages = sorted(counts)
        smoothed = np.full((BUCKETS, len(counts)), 0.05)
        for at, lang in enumerate(self.languages):
            smoothed[:, at] += counts[lang]
        self.logs = np.log(smoothed / smoothed.sum(axis=0)).astype(np.float32)

    @classmethod
    def of(cls, rows: list[tuple[str, str]]) -> TextModel:
        """Fitted to texts and their languages."""
        counts = {lang: np.zeros(BUCKETS, np.int64) for _, lang in rows}
        for text, lang in rows:
            counts[lang] += np.bincount(gram_cells(text), minlength=BUCKETS)
        return cls(counts)

    def evidence(self, text: str) -> np.ndarray:
        """Log likelihoods of the whole text, tempered; zeros for a text without letters."""
        total = np.zeros(len(self.languages))
        cells = gram_cells(text)
        for at in range(0, len(cells), 1 << 16):
            total += self.logs[cells[at : at + (1 << 16)]].sum(axis=0, dtype=np.float64)
        return TEXT_WEIGHT * total


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return F.nullif(F.regexp_replace(host, r"^(?:www|m)\.", ""), F.lit(""))


def parent_of(host: Column) -> Column:
    """The last two labels of a host name; a name without dots is its own parent."""
    return F.regexp_extract(host, r"([^.]+\.[^.]+|[^.]+)\.?$", 1)


def suffix_language(url: Column, host: Column, languages: list[str]) -> Column:
    """A first path part that is a language, else what the top-level domain suggests."""
    path = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]+/([A-Za-z]{2})(?:[-_][A-Za-z]{2})?(?:[/?#]|$)", 1))
    tops = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    return F.when(path.isin(languages), path).otherwise(tops[F.regexp_extract(host, r"\.([a-z]+)\.?$", 1)])


def declared_language(html: Column) -> Column:
    """The lang attribute of the html element (without its region), else none."""
    return F.nullif(F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)), F.lit(""))


def visible_text(html: Column) -> Column:
    """Without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"&(?:#?\w+);", " ")


def host_priors(rows: DataFrame, languages: list[str]) -> DataFrame:
    """(host, n array<double>, above array<double>, both in the order of languages): how many rows declare each language,
    and the smoothed share of each in the parent domain."""
    known = rows.where(F.col("declared").isin(languages)).groupBy("host", "declared").agg(F.count("*").alias("n"))
    counts = [F.sum(F.when(F.col("declared") == lang, F.col("n")).otherwise(0)).alias(f"n_{i}") for i, lang in enumerate(languages)]
    hosts = materialize(known.groupBy("host").agg(*counts).withColumn("parent", parent_of(F.col("host"))), "hosts")
    summed = [F.sum(f"n_{i}").alias(f"p_{i}") for i in range(len(languages))]
    parents = hosts.groupBy("parent").agg(*summed)
    row = hosts.agg(*[F.sum(f"n_{i}") for i in range(len(languages))]).first()  # one number a language
    whole = [(n or 0) + 1 for n in row]
    top = F.array(*[F.lit(n / sum(whole)) for n in whole])
    vector = lambda p: F.array(*[F.coalesce(F.col(f"{p}_{i}"), F.lit(0)).cast("double") for i in range(len(languages))])
    above = parents.select(F.col("parent").alias("_parent"), smoothed(vector("p"), top, PARENT_PRIOR).alias("above"))
    out = hosts.join(above, F.col("parent").eqNullSafe(F.col("_parent")))
    return out.select("host", vector("n").alias("n"), "above")


def smoothed(counts: Column, prior: Column, weight: float) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(counts, prior, lambda x, p: (x + weight * p) / (total + weight))


def quotas(counts: dict[str, int], limit: int) -> dict[str, int]:
    """Texts of each language to train on: all of the small languages, equal numbers of the others, one at least."""
    out, left = {}, limit
    for at, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = max(1, min(n, left // (len(counts) - at)))
        left -= out[lang]
    return out


def training_rows(rows: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """(text, declared): at most ``limit`` rows, or one for each declared language if there are more languages.  The
    languages come from a grouped count over all rows.  Rows that repeat an id or a text count as rows."""
    labelled = rows.where("declared is not null and text <> ''").select(F.xxhash64("id", "text").alias("h"), "text", "declared")
    found = labelled.groupBy("declared").agg(F.count("*").alias("n"), F.min("h").alias("least")).collect()  # one row a language
    counts = {r["declared"]: r["n"] for r in found}
    quota = quotas(counts, limit)
    # Somewhat more than the quota by the hash's share of its range, and always the least hash.
    share = {lang: min(1.0, (q + 4 * q**0.5 + 4) / counts[lang]) for lang, q in quota.items()}
    most = {lang: 2**63 - 1 if x == 1 else int((2 * x - 1) * 2**63) for lang, x in share.items()}
    most = {r["declared"]: max(most[r["declared"]], r["least"]) for r in found}
    if not most:
        return labelled.select("text", "declared").limit(0)

    def by_language(numbers: dict[str, int]) -> Column:
        return F.create_map(*[c for lang, n in sorted(numbers.items()) for c in (F.lit(lang), F.lit(n).cast("long"))])[F.col("declared")]

    rank = F.row_number().over(Window.partitionBy("declared").orderBy("h", "text"))
    chosen = labelled.where(F.col("h") <= by_language(most)).withColumn("rank", rank).where(F.col("rank") <= by_language(quota))
    return chosen.select("text", "declared")


def fit(rows: DataFrame, limit: int = TRAIN_ROWS) -> TextModel:
    """Fitted to the training rows, whose grams are counted where the texts are; cells and numbers reach the driver, at
    most ``BUCKETS`` a language."""

    def count(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                counts[lang] += np.bincount(gram_cells(text), minlength=BUCKETS)
        for lang, n in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([n], pa.list_(pa.int64()))], names=["declared", "n"])

    chosen = training_rows(rows, limit)
    dealt = chosen.repartition(F.pmod(F.xxhash64("text"), F.lit(64)))  # long texts of one language on many tasks
    found = dealt.mapInArrow(count, "declared string, n array<long>")
    cells = found.select("declared", F.posexplode("n").alias("cell", "n")).where("n > 0").groupBy("declared", "cell").agg(F.sum("n").alias("n"))
    by_language = cells.groupBy("declared").agg(F.collect_list("cell").alias("cells"), F.collect_list("n").alias("n"))
    out: dict[str, np.ndarray] = {}
    for r in by_language.collect():  # one row a language
        out[r["declared"]] = np.zeros(BUCKETS, np.int64)
        out[r["declared"]][r["cells"]] = r["n"]
    named = [r["declared"] for r in chosen.select("declared").distinct().collect()]  # a text without letters has no cells
    return TextModel({lang: out.get(lang, np.zeros(BUCKETS, np.int64)) for lang in named})


def identify(df: DataFrame, id_col: str, text: Column, declared: Column, url: Column, host: Column, model: TextModel | None = None, carry: bool = False) -> DataFrame:
    """(id, language, posterior, text_language, kept): one row for each row of df.

    text, declared, url and host are columns over df; any may be null.  model: fitted before, else fitted here.
    carry: adds df's own columns as one struct ``row``, out of the way of any name.
    """
    rows = df.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(text.cast("string"), F.lit("")).alias("text"),
        F.nullif(F.lower(declared.cast("string")), F.lit("")).alias("declared"),
        url.cast("string").alias("url"),
        host.cast("string").alias("host"),
        *([F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")] if carry else []),
    )
    kept_too = ["row"] if carry else []
    if model is None:
        model = fit(rows)
    languages = model.languages
    if not languages:
        nothing = F.lit(None).cast("string")
        return rows.select("id", F.lit("und").alias("language"), F.lit(0.0).alias("posterior"), nothing.alias("text_language"), F.lit(False).alias("kept"), *kept_too)
    priors = materialize(host_priors(rows.select("host", "declared"), languages), "host-priors")
    slim = rows.withColumn("suffix", suffix_language(F.col("url"), F.col("host"), languages)).select("id", "text", "declared", "suffix", "host", *kept_too)

    shape = slim.drop("text").withColumn("said", F.lit(None).cast("array<double>")).schema

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [model.evidence(t) for t in batch.column(1).to_pylist()]
        flat = np.array(found).ravel()
        offsets = np.arange(0, len(flat) + 1, len(languages), dtype=np.int32)
        return pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.ListArray.from_arrays(offsets, flat)], names=[*shape.names[:-1], "said"])

    said = map_texts(slim, of, shape)
    named = priors.select(F.col("host").alias("_host"), "n", "above")
    joined = said.join(named, F.col("host").eqNullSafe(F.col("_host")), "left")

    names = F.array(*[F.lit(x) for x in languages])
    flat = F.array(*[F.lit(1 / len(languages))] * len(languages))
    others = F.zip_with("n", names, lambda n, x: F.greatest(n - F.coalesce(x == F.col("declared"), F.lit(False)).cast("double"), F.lit(0.0)))
    prior = F.coalesce(smoothed(others, F.col("above"), HOST_PRIOR), flat)

    def trust(column: str, right: float) -> Column:
        wrong = np.log((1 - right) / max(1, len(languages) - 1)) if len(languages) > 1 else 0.0
        known = F.array_contains(names, F.col(column))
        return F.transform(names, lambda x: F.when(known, F.when(x == F.col(column), float(np.log(right))).otherwise(float(wrong))).otherwise(0.0))

    logs_of = F.zip_with(F.col("said"), F.transform(prior, lambda p: F.log(p)), lambda a, b: a + b)
    logs_of = F.zip_with(logs_of, trust("declared", DECLARED_TRUST), lambda a, b: a + b)
    logs_of = F.zip_with(logs_of, trust("suffix", SUFFIX_TRUST), lambda a, b: a + b)
    scored = joined.select("id", "said", F.exists("said", lambda x: x != 0).alias("letters"), logs_of.alias("logs"), *kept_too)
    scored = scored.withColumn("top", F.array_max("logs"))
    scored = scored.withColumn("posterior", 1 / F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top"))))
    kept = F.col("letters") & (F.col("posterior") >= LEAST_POSTERIOR)
    best = lambda v: F.element_at(names, F.array_position(v, F.array_max(v)).cast("int"))
    spoke = F.when(F.col("letters"), best(F.col("said")))
    return scored.select("id", F.when(kept, best(F.col("logs"))).otherwise("und").alias("language"), "posterior", spoke.alias("text_language"), kept.alias("kept"), *kept_too)


def identify_documents(df: DataFrame, id_col: str = "doc_id", carry: bool = False) -> DataFrame:
    """Documents: ``lang`` is what the page declared, ``source`` the host; there is no address."""
    none = F.lit(None).cast("string")
    return identify(df, id_col, F.col("text"), F.col("lang"), none, F.col("source"), carry=carry).withColumnRenamed("id", "doc_id")


def accepted_documents(df: DataFrame) -> DataFrame:
    """The rows of df, all columns, whose language is settled."""
    return identify_documents(df, carry=True).where("kept").select("row.*")


def identify_pages(df: DataFrame) -> DataFrame:
    """Web pages: all evidence comes from the address and the markup."""
    return identify(df, "page_id", visible_text(F.col("html")), declared_language(F.col("html")), F.col("url"), host_of(F.col("url"))).withColumnRenamed("id", "page_id")
