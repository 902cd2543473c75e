"""Quality of documents by hierarchical empirical Bayes.

Three levels of evidence meet.  A logistic classifier sees the document alone (shape of words,
letters, repetition).  Labelled outcomes are counted per site and per path of a site; a path's rate
is shrunk towards its site's posterior, a site's towards the rate of all labelled documents, by
beta-binomial priors whose strength is estimated from the counts.  The document's log odds are the
classifier's plus the site's shift against the global rate, so that a site without labels leaves
the classifier's answer as it is.

No document's own label enters its score: it is taken out of the counts of its path and site, and
documents are dealt by a hash of their ids into two halves, each scored by the classifier that was
fitted on the other half.

The classifiers are fitted on at most ``sample`` labelled rows in all, chosen by a hash of their ids;
counts cover all labelled rows.  Only counts and features are grouped or joined, never texts; a site
with a third of all rows is one row of the table after map-side aggregation.

Null texts count as empty.  Null sites and paths are a site and a path of their own.  A document with
several labels has their majority (ties: good); one whose labels are all null, or whose id is null, has
none.  Without labels every document gets the prior 0.5.  Repeated rows are scored each; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import frugal, named, written
from .words import words_of

NAMES = ("log_words", "word_bytes", "upper", "digit", "symbol", "wide", "distinct", "repeat", "lines", "symbol_words", "caps_words", "edge_symbols")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = np.zeros((4, 256), np.float64)
    kinds[0, 65:91] = 1  # A-Z
    kinds[1, 48:58] = 1  # digits
    kinds[3, 128:] = 1  # beyond ASCII
    kinds[2, 33:127] = 1
    kinds[2, 48:58] = kinds[2, 65:91] = kinds[2, 97:123] = 0
    for code in b".,;:'\"()-?":
        kinds[2, code] = 0
    plain = np.zeros(256, bool)
    plain[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
    for batch in batches:
        for words in words_of(batch.column(batch.num_columns - 1)):
            n, first, rows = words.counts, words.first, words.rows
            data, text = words.data, words.text_of_word
            size = (words.end - words.begin).astype(np.float64)
            lower = np.maximum(n, 1)

            def per_text(value: np.ndarray, first=first) -> np.ndarray:
                total = np.append(0.0, np.cumsum(value))
                return total[first[1:]] - total[first[:-1]]

            def in_words(kind: np.ndarray, data=data, words=words) -> np.ndarray:
                total = np.append(0.0, np.cumsum(kind[data]))
                return total[words.end] - total[words.begin]

            letters = np.maximum(per_text(size), 1)
            upper, symbol = in_words(kinds[0]), in_words(kinds[2])
            small = (data >= 97) & (data <= 122)
            smalls = np.append(0, np.cumsum(small))
            has_small = smalls[words.end] > smalls[words.begin]
            order = np.lexsort((words.hashes, text))
            h, t = words.hashes[order], text[order]
            new = np.append(True, (h[1:] != h[:-1]) | (t[1:] != t[:-1])) if len(h) else np.zeros(0, bool)
            distinct = np.bincount(t[new], minlength=rows)
            again = np.append(False, words.hashes[1:] == words.hashes[:-1]) if len(h) else np.zeros(0, bool)
            breaks = np.append(0, np.cumsum(data == 10))
            last_byte = data[words.end - 1] if len(h) else data[:0]
            edge = ~plain[last_byte] & ~np.isin(last_byte, np.frombuffer(b".,;:'\"()-?0123456789", np.uint8))
            lines = np.zeros(rows)
            there = n > 0
            lines[there] = breaks[words.end[first[1:][there] - 1]] - breaks[words.begin[first[:-1][there]]]
            values = [
                np.log1p(n), per_text(size) / lower, per_text(upper) / letters, per_text(in_words(kinds[1])) / letters, per_text(symbol) / letters,
                per_text(in_words(kinds[3])) / letters, distinct / lower, per_text(again) / lower, lines / lower, per_text((symbol > 0).astype(float)) / lower,
                per_text(((upper > 1) & ~has_small).astype(float)) / lower, per_text(edge.astype(float)) / lower,
            ]
            made = np.stack(values, axis=1) if rows else np.zeros((0, len(NAMES)))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, rows * len(NAMES) + 1, len(NAMES), dtype=np.int32)), pa.array(made.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(words.row, rows) for k in range(batch.num_columns - 1)), flat], names=["id", "site", "path", "x"])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, scales and weights (intercept first) of a ridge logistic regression by Newton steps.
    Values are standardised, cut at 6 deviations, and enter with their squares."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = design(x, mean, scale)
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def design(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -6, 6)
    return np.concatenate([np.ones((len(z), 1)), z, z * z], axis=1)


def _odds(x: str, mean: np.ndarray, scale: np.ndarray, w: np.ndarray) -> Column:
    """The classifier's log odds as one expression over the feature array."""
    out = F.lit(float(w[0]))
    for k in range(len(mean)):
        z = F.greatest(F.lit(-6.0), F.least(F.lit(6.0), (F.col(x)[k] - float(mean[k])) / float(scale[k])))
        out = out + z * float(w[1 + k]) + z * z * float(w[1 + len(mean) + k])
    return out


def _strength(members: DataFrame) -> float:
    row = members.where("n > 1").agg(
        F.sum(F.expr("n * parent * (1 - parent)")).alias("b"), F.sum(F.expr("pow(good - n * parent, 2)")).alias("s"), F.sum(F.expr("n * (n - 1) * parent * (1 - parent)")).alias("e")
    ).first()
    if not row["e"]:
        return 10.0
    rho = min(0.999, max(1e-4, (row["s"] - row["b"]) / row["e"]))
    return 1 / rho - 1


def site_counts(labelled: DataFrame) -> tuple[DataFrame, DataFrame, float, float, float]:
    """From rows (site, path, good): labelled and good rows per site and per path, the global rate, and
    the priors' strengths at the levels of sites and paths."""
    paths = written(labelled.groupBy("site", "path").agg(F.count("*").cast("double").alias("n"), F.sum("good").cast("double").alias("good")), "paths")
    total = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    rate = ((total["good"] or 0) + 0.5) / ((total["n"] or 0) + 1)
    sites = written(paths.groupBy("site").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("parent", F.lit(rate)), "sites")
    by_site = _strength(sites)
    mean = (F.col("s.good") + by_site * F.col("s.parent")) / (F.col("s.n") + by_site)
    members = paths.alias("p").join(sites.alias("s"), F.col("p.site").eqNullSafe(F.col("s.site"))).select("p.*", mean.alias("parent"))
    return sites.drop("parent"), paths, rate, by_site, _strength(members)


def _classifier(rows: list) -> Column:
    """Log odds by a classifier fitted on these rows; a constant where they have one class."""
    y = np.array([r["good"] for r in rows], float)
    if len(set(y.tolist())) == 2:
        return _odds("x", *fit_logistic(np.array([r["x"] for r in rows]), y))
    return F.lit(4.0 * (y.mean() - 0.5) if len(y) else 0.0)


def drawn(labelled: DataFrame, sample: int) -> DataFrame:
    """The ``sample`` rows whose ids hash least.  Every task hands its own least rows to the driver, so
    only hashes below a bound that 1.2 times the sample are expected to pass come that far."""
    hashed = F.xxhash64(F.lit(3), F.col("id"))
    share = 1.2 * sample / max(1, labelled.count())
    near = labelled if share >= 1 else labelled.where(hashed < F.lit(int(share * 2**64) - 2**63))
    return near.orderBy(hashed, "id").limit(sample)


def quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", path_col: str = "lang",
    label_id: str = "doc_id", label_col: str = "quality", sample: int = 20_000, keep_at: float = 0.5,
) -> DataFrame:
    """One row per row of ``docs``: id, p_document (classifier), p_site (posterior of its path, site
    or all), p_quality (both together) and kept (p_quality >= keep_at)."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(named(id_col).alias("id"), named(site_col).cast("string").alias("site"), named(path_col).cast("string").alias("path"), named(text_col).alias("text"))
    made = rows.mapInArrow(frugal(_features), f"id {kind}, site string, path string, x array<double>")
    votes = labels.where(named(label_col).isNotNull()).groupBy(named(label_id).alias("id")).agg(F.when(F.avg(named(label_col)) >= 0.5, 1).otherwise(0).alias("good"))
    half = F.pmod(F.xxhash64(F.lit(5), F.col("id")), F.lit(2))
    made = written(made.join(votes, "id", "left").withColumn("half", half), "features")
    labelled = made.where("good is not null")
    taken = drawn(labelled, sample).select("x", "good", "half").collect()
    halves = [[r for r in taken if r["half"] == h] for h in (0, 1)]
    if any(len({r["good"] for r in own}) < 2 for own in halves):  # too few labels to set any aside
        halves = [taken, taken]
    odds = F.when(F.col("half") == 0, _classifier(halves[1])).otherwise(_classifier(halves[0]))
    sites, paths, rate, by_site, by_path = site_counts(labelled)
    scored = made.select("id", "site", "path", "good", odds.alias("odds")).alias("d")
    own = (F.col("d.site").eqNullSafe(F.col("p.site"))) & (F.col("d.path").eqNullSafe(F.col("p.path")))
    scored = scored.join(paths.alias("p"), own, "left").join(sites.alias("s"), F.col("d.site").eqNullSafe(F.col("s.site")), "left")
    zero = F.lit(0.0)
    mine, good = F.when(F.col("d.good").isNotNull(), 1.0).otherwise(zero), F.coalesce(F.col("d.good").cast("double"), zero)
    at_site = (F.coalesce("s.good", zero) - good + by_site * rate) / (F.coalesce("s.n", zero) - mine + by_site)
    at = (F.coalesce("p.good", zero) - good + by_path * at_site) / (F.coalesce("p.n", zero) - mine + by_path)
    shift = F.log(at / (1 - at)) - F.log(F.lit(rate / (1 - rate)))
    both = F.col("odds") + shift
    chance = lambda v: 1 / (1 + F.exp(-v))
    return scored.select(F.col("d.id").alias(id_col), chance(F.col("odds")).alias("p_document"), at.alias("p_site"), chance(both).alias("p_quality"), (chance(both) >= keep_at).alias("kept"))
