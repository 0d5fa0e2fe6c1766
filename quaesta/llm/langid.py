"""Language identification by fused evidence (operator 7).

For every text four kinds of evidence are added as log-probabilities: a naive Bayes
likelihood of hashed byte trigrams of the whole text (tempered, so that a long text
counts as a bounded number of independent ones), the language its markup declares, the
suffix of its address, and a prior of its host. One more class, ``other``, gives every trigram the same
chance: text unlike all languages (another script or language, code, random letters) falls to it. Host priors come from grouped sums of
first-pass posteriors, smoothed from host to domain to suffix to the whole corpus, and leave the row's own share out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import enter, written

LANGUAGES = ("de", "en", "es", "fr")
OTHER = "other"
#: Log-probability of any trigram in class ``other``.
BACKGROUND = -11.5
#: What every count of a trigram is raised by.
SMOOTH = 0.1
#: Different labelled texts of each language that the trigram model is fitted on at most: those of the least hashes.
TRAIN_ROWS = 300
BUCKETS = 1 << 15
#: Independent trigrams that a long text counts as.
EFFECTIVE = 60.0
#: Strength of the parent level in a prior, in rows.
KAPPA = 5.0
#: Chance that a declared language, and that of a suffix, is right.
DECLARED_RIGHT, SUFFIX_RIGHT = 0.9, 0.8
MIN_POSTERIOR = 0.5
#: Hosts whose priors are broadcast at most; beyond, rows meet them by a join.
BROADCAST_HOSTS = 100_000
#: Bytes of text whose trigrams are held at once.
STEP = 1 << 20
#: Languages of country suffixes; fixed values.
SUFFIXES = {"de": "de", "at": "de", "li": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "co": "es", "uk": "en", "us": "en", "au": "en", "nz": "en", "ie": "en"}

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_LETTER = np.array([c >= 128 or 97 <= c <= 122 for c in range(256)])
_DIGIT = np.array([48 <= c <= 57 for c in range(256)])


def _buckets(raw: np.ndarray) -> np.ndarray:
    letter, digit, b = _LETTER[raw], _DIGIT[raw], raw.astype(np.uint32)
    code = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761)
    return (code >> np.uint32(17))[(letter[:-2] | letter[1:-1] | letter[2:]) & ~(digit[:-2] | digit[1:-1] | digit[2:])]


def trigrams(text: str | None):
    """Buckets of the byte trigrams that hold a letter and no digit, part after part; A-Z lowered, other bytes as they are."""
    raw = np.frombuffer((" " + (text or "") + " ").encode("utf-8", "surrogatepass").translate(_LOWER), np.uint8)
    for at in range(0, len(raw) - 2, STEP):
        yield _buckets(raw[at : at + STEP + 2])


def has_letter(text: str) -> bool:
    return any(c >= "\x80" or "A" <= c <= "Z" or "a" <= c <= "z" for c in text)


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """Classes by buckets, smoothed; ``other`` last."""
    counts = counts + SMOOTH
    known = np.log(counts / counts.sum(axis=1, keepdims=True))
    return np.concatenate([known, np.full((1, BUCKETS), BACKGROUND)]).astype(np.float32)


def fit(rows: list[tuple[str, str]], languages: tuple[str, ...] = LANGUAGES) -> np.ndarray:
    """The model of labelled texts that are at hand."""
    counts = np.zeros((len(languages), BUCKETS))
    for lang, text in rows:
        if lang in languages:
            for g in trigrams(text):
                counts[languages.index(lang)] += np.bincount(g, minlength=BUCKETS)
    return log_probabilities(counts)


def _count(batches):
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(*batch.columns, strict=True):
            total = held.setdefault(lang.as_py(), np.zeros(BUCKETS, np.int64))
            for g in trigrams(text.as_py()):
                total += np.bincount(g, minlength=BUCKETS)
    for lang, total in held.items():
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(total[at])], ["lang", "bucket", "n"])


def train(docs: DataFrame, text_col: str, label_col: str, languages: tuple[str, ...] = LANGUAGES, rows: int = TRAIN_ROWS) -> np.ndarray:
    """The model, fitted on at most ``rows`` different labelled texts of each language: whole texts, chosen by hash, counted on
    the executors. The driver gets one number for each language and bucket at most."""
    labelled = docs.select(F.col(label_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where(F.col("lang").isin(*languages) & F.col("text").isNotNull())
    labelled = labelled.withColumn("h", F.xxhash64("text"))
    part = F.lit(0)
    for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect():
        # more than enough, so that repeated texts do not leave too few
        part = F.when(F.col("lang") == r["lang"], F.lit(min(1 << 30, int(8 * rows / r["n"] * (1 << 30)) + 1))).otherwise(part)
    some = labelled.where(F.pmod("h", F.lit(1 << 30)) < part)
    first = some.groupBy("lang", "h").agg(F.lit(1).alias("one")).withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= rows)
    # at most ``rows`` texts of each language
    chosen = some.join(F.broadcast(first.select("lang", "h")), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    counts = np.zeros((len(languages), BUCKETS))
    for r in chosen.select("lang", "text").mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect():
        counts[languages.index(r["lang"]), r["bucket"]] = r["n"]
    return log_probabilities(counts)


def text_scores(spark, model: np.ndarray):
    """A column function: text to tempered log-likelihoods of the classes, null without letters."""
    shared = spark.sparkContext.broadcast(np.ascontiguousarray(model.T))  # classes x 32768 numbers

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def score(texts):
        import pandas as pd

        enter("langid")
        m, out = shared.value, []
        for t in texts:
            total, n = np.zeros(m.shape[1]), 0
            for g in trigrams(t):
                for i in range(0, len(g), 65536):
                    total += m[g[i : i + 65536]].sum(axis=0, dtype=np.float64)
                n += len(g)
            if n:
                out.append((total / n * min(float(n), EFFECTIVE)).tolist())
            else:  # letters beside digits alone say nothing; without a letter there is no language
                out.append([0.0] * m.shape[1] if t and has_letter(t) else None)
        return pd.Series(out)

    return score


def _likelihood(value: Column, languages: tuple[str, ...], right: float) -> list[Column]:
    """log P(evidence | class) for each class; zeroes where the evidence names none of the languages."""
    wrong = float(np.log((1 - right) / len(languages)))
    known = F.coalesce(value.isin(*languages), F.lit(False))
    return [F.when(known, F.when(value == c, F.lit(float(np.log(right)))).otherwise(F.lit(wrong))).otherwise(F.lit(0.0)) for c in (*languages, OTHER)]


def _softmax(logs: Column) -> Column:
    """The array of posteriors. Each step binds its array once: spelt out for each language, the expression outgrows what Spark compiles."""
    weights = F.transform(F.array(logs), lambda v: F.transform(v, lambda x: F.exp(x - F.array_max(v))))[0]
    return F.transform(F.array(weights), lambda w: F.transform(w, lambda x: x / F.aggregate(w, F.lit(0.0), lambda t, y: t + y)))[0]


def evidence(docs: DataFrame, score, text: Column, declared: Column, host: Column, languages: tuple[str, ...]) -> DataFrame:
    """``docs`` with ``__e`` (log evidence of each language without the host), ``__p`` (its posterior) and ``__host``."""
    suffix = F.regexp_extract(F.lower(host), r"\.([a-z]+)\.?$", 1)
    named = F.create_map(*(F.lit(x) for kv in SUFFIXES.items() for x in kv))
    lang = F.coalesce(F.lower(F.regexp_extract(F.trim(declared), r"^([A-Za-z]{2,3})(?:[-_].*)?$", 1)), F.lit(""))
    out = docs.withColumns({"__t": score(text), "__host": F.lower(F.coalesce(host, F.lit(""))), "__l": lang, "__s": F.try_element_at(named, suffix)})
    d, s = _likelihood(F.col("__l"), languages, DECLARED_RIGHT), _likelihood(F.col("__s"), languages, SUFFIX_RIGHT)
    e = F.array(*(F.col("__t")[i] + d[i] + s[i] for i in range(len(languages) + 1)))
    out = out.withColumn("__e", F.when(F.col("__t").isNotNull(), e)).drop("__t", "__l", "__s")
    return out.withColumn("__p", _softmax(F.col("__e")))


def host_priors(rows: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """``__host``, rows ``__n``, sums ``__c`` and its domain's smoothed prior ``__d``: one row a host, by grouped sums level over level."""
    k = len(languages) + 1
    c = [f"c{i}" for i in range(k)]

    def summed(df: DataFrame, by: list[str], n) -> DataFrame:
        return df.groupBy(*by).agg(n.alias("n"), *(F.sum(x).alias(x) for x in c))

    first = rows.where(F.col("__p").isNotNull()).select("__host", *(F.col("__p")[i].alias(c[i]) for i in range(k)))
    hosts = summed(first, ["__host"], F.count("*").cast("double"))
    hosts = hosts.withColumns({"domain": F.coalesce(F.nullif(F.regexp_extract("__host", r"([^.]+\.[^.]+)$", 1), F.lit("")), F.col("__host")), "suffix": F.regexp_extract("__host", r"\.([^.]+)$", 1)})
    hosts = written(hosts, "hosts")
    domains = summed(hosts, ["domain", "suffix"], F.sum("n"))
    suffixes = summed(domains, ["suffix"], F.sum("n"))
    top = summed(suffixes, [], F.sum("n")).first()
    n = float(top["n"] or 0)
    world = [(float(top[x] or 0) + 1.0) / (n + k) for x in c]

    def smooth(df: DataFrame, parent: list[Column]) -> DataFrame:
        return df.withColumn("q", F.array(*((F.col(c[i]) + KAPPA * parent[i]) / (F.col("n") + KAPPA) for i in range(k))))

    suffixes = smooth(suffixes, [F.lit(x) for x in world]).select("suffix", F.col("q").alias("qs"))
    domains = smooth(domains.join(suffixes, "suffix"), [F.col("qs")[i] for i in range(k)]).select("domain", "suffix", F.col("q").alias("__d"))
    return hosts.join(domains, ["domain", "suffix"]).select("__host", F.col("n").alias("__n"), F.array(*c).alias("__c"), "__d")


def identify(
    docs: DataFrame, model: np.ndarray, text: Column, declared: Column | None = None, host: Column | None = None,
    languages: tuple[str, ...] = LANGUAGES, min_posterior: float = MIN_POSTERIOR, keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``pred_lang``, ``posterior`` and ``accepted`` (which replace columns of those names).

    A null or empty text, or one without letters, has no language (null, posterior null) and is not accepted. Else the
    class is the most probable one, the first by name on a tie (``other`` last); it is accepted from ``min_posterior`` on if it is a language. Null or unknown
    declarations, suffixes without a language, null hosts, and letters beside digits alone are no evidence. Repeated rows count each; a text of any length is scored part by part; an empty table gives no rows.
    The rows with their evidence are written once, and each text is read once.
    """
    own = [c for c in keep or docs.columns if c not in ("pred_lang", "posterior", "accepted")]
    base = docs.select(*docs.columns, text.cast("string").alias("__text"), (F.lit(None) if declared is None else declared).cast("string").alias("__decl"), (F.lit(None) if host is None else host).cast("string").alias("__h"))
    held = evidence(base, text_scores(docs.sparkSession, model), F.col("__text"), F.col("__decl"), F.col("__h"), languages)
    held = written(held.select(*own, "__e", "__p", "__host").withColumn("__row", F.monotonically_increasing_id()), "evidence")
    priors = written(host_priors(held, languages), "priors")
    small = priors.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    # few hosts are broadcast; many are joined with narrow rows, and texts then move by row number, never by host
    rows = held.join(F.broadcast(priors), "__host", "left") if small else held.select("__row", "__host", "__e", "__p").join(priors, "__host", "left")
    k = len(languages) + 1
    less = [(F.greatest(F.col("__c")[i] - F.col("__p")[i], F.lit(0.0)) + KAPPA * F.col("__d")[i]) / (F.col("__n") - 1 + KAPPA) for i in range(k)]
    rows = rows.withColumn("__post", _softmax(F.array(*(F.col("__e")[i] + F.log(less[i]) for i in range(k)))))
    rows = rows.withColumn("posterior", F.array_max("__post"))
    place = F.array_position("__post", F.col("posterior")).cast("int")
    rows = rows.withColumn("pred_lang", F.when(F.col("posterior").isNotNull(), F.element_at(F.array(*map(F.lit, (*languages, OTHER))), place)))
    rows = rows.withColumn("accepted", F.coalesce((F.col("posterior") >= min_posterior) & (F.col("pred_lang") != OTHER), F.lit(False)))
    if not small:
        rows = held.select("__row", *own).join(rows.select("__row", "pred_lang", "posterior", "accepted"), "__row")
    return rows.select(*own, "pred_lang", "posterior", "accepted")


def page_languages(pages: DataFrame, model: np.ndarray, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page ``page_id, host, declared, pred_lang, posterior, accepted``: the text between its tags, the language that its ``html`` tag declares, the host of its address.

    A null address has an empty host, a null page no text; other columns are ignored.
    """
    html = F.col(html_col).cast("string")
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    declared = F.regexp_extract(bare, r"""(?is)<html\b[^>]*?\slang\s*=\s*["']?([^"'\s>]+)""", 1)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"(?s)^.*?://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), declared.alias("declared"), F.regexp_replace(bare, r"(?s)<[^>]*>", " ").alias("page"))
    out = identify(rows, model, F.col("page"), F.col("declared"), F.col("host"), keep=["page_id", "host", "declared"])
    return out.select("page_id", "host", "declared", "pred_lang", "posterior", "accepted")
