"""Language of texts by a linear-chain conditional random field over words.

Every word has a label, its language.  Features of a word are its identity (lexicon), its prefixes
and suffixes of 1 to 3 letters and its letter bigrams and trigrams, hashed into ``FEATURES`` slots;
labels of neighbours are tied by learned transitions.  Forward-backward gives each word's posterior,
so a text may switch languages; a text's language is the one with the greatest mean posterior, which
is also the score.  Chains are runs of at most ``CHAIN`` words of one text.  A run of more than
``LETTERS`` letters (glued text, scripts without spaces) is several words of that many letters.

Weights are learned by conditional likelihood on a bounded sample of labelled rows: about
``sample`` texts, an equal share for every language and at least ``least`` of each that has them,
chosen by a hash of their ids.  Texts of more than ``longest`` characters teach only where a language
has no other.  Only feature slots that occur in the sample have weights.  Words of a training text
carry its label.  Prediction uses the text alone.

A letter is what Unicode calls one (``str.isalpha``).  A text that is null or has no letter gets
``und`` with score 0, and so does any text if there are no labelled rows.  Repeated rows are predicted
each; ids may be null; an empty table gives no rows; other columns, whatever their names, stay.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import frugal, named, quoted

FEATURES = 1 << 17
CHAIN = 64
#: Distinct words a task keeps scores of.
CACHE = 100_000
LETTERS = 24
UND = "und"
#: Words of a long text that are judged at once, in whole chains.
SECTION = CHAIN * 512
_WORDS = re.compile(rf"[^\W\d_]{{1,{LETTERS}}}").findall
_EACH = re.compile(rf"[^\W\d_]{{1,{LETTERS}}}").finditer


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points, one row a word with a border on each side, and the lengths."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    points = np.array(words, dtype=f"U{LETTERS}").view(np.uint32).reshape(len(words), LETTERS)
    out = np.zeros((len(words), LETTERS + 2), np.uint64)
    out[:, 1:-1] = points
    out[:, 0] = 2
    out[np.arange(len(words)), length + 1] = 3
    return out, length


def _slots(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return 1 + (h >> np.uint64(40)).astype(np.int64) % (FEATURES - 1)


def features(words: list[str]) -> np.ndarray:
    """Feature slots of lower-cased words, a row each; slot 0 stands for none."""
    if not words:
        return np.zeros((0, 1), np.int32)
    p, length = _letters(words)
    n, width = p.shape
    m = np.uint64(1_000_003)
    columns = []
    two = p[:, :-1] * m + p[:, 1:]
    three = two[:, :-1] * m + p[:, 2:]
    used = int(length.max()) + 2
    for grams, size, kind in ((two, 2, 1), (three, 3, 2)):
        there = np.arange(width - size + 1)[None, :] <= (length + 2 - size)[:, None]
        columns.append(np.where(there, _slots(grams, kind), 0)[:, : max(1, used - size + 1)])
    rows, whole = np.arange(n), np.zeros(n, np.uint64)
    for k in range(width):  # not only the columns in use, which depend on the other words
        whole = whole * m + p[:, k] * np.uint64(0x100000001B3)
    head, tail = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    affixes = [_slots(whole, 3)]
    for k in (1, 2, 3):
        head = head * m + p[:, k]
        affixes.append(np.where(length >= k, _slots(head, 3 + k), 0))
        tail = tail * m + p[rows, np.maximum(length + 1 - k, 0)]
        affixes.append(np.where(length >= k, _slots(tail, 6 + k), 0))
    columns.append(np.stack(affixes, axis=1))
    return np.concatenate(columns, axis=1).astype(np.int32)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # a row for each feature slot, or for each that has weights, after a row of zeros
    transitions: np.ndarray  # from x to
    start: np.ndarray
    row_of: np.ndarray | None = None  # the weights' row of each slot

    def word_scores(self, words: list[str]) -> np.ndarray:
        out = np.empty((len(words), len(self.languages)), np.float32)
        for at in range(0, len(words), 8192):
            slots = features(words[at : at + 8192])
            out[at : at + 8192] = self.weights[slots if self.row_of is None else self.row_of[slots]].sum(axis=1)
        return out


def chains(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts' word counts to chains: text, first word and length of each."""
    n = -(-counts // CHAIN)
    text = np.repeat(np.arange(len(counts)), n)
    part = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    first = np.repeat(np.cumsum(counts) - counts, n) + part * CHAIN
    return text, first, np.minimum(CHAIN, counts[text] - part * CHAIN)


def forward_backward(scores: np.ndarray, first: np.ndarray, length: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Posteriors of all words, expected transitions and starts, and the log partition of all chains.

    ``scores`` are the words' label scores; all chains are advanced together, a step at a time."""
    k = scores.shape[1]
    posterior = np.zeros((len(scores), k))
    pairs, starts, total = np.zeros((k, k)), np.zeros(k), 0.0
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    trans, start = np.exp(model.transitions), np.exp(model.start)
    top = scores.max(axis=1, keepdims=True)
    emit = np.exp(scores - top)
    for at in range(0, len(first), 20_000):  # bounded work space
        f, n = first[at : at + 20_000], length[at : at + 20_000]
        steps = int(n[0]) if len(n) else 0
        live = [int(np.searchsorted(-n, -t, side="left")) for t in range(steps)]  # chains longer than t
        alpha, scale = np.zeros((steps, len(f), k)), np.ones((steps, len(f)))
        for t in range(steps):
            m = live[t]
            a = emit[f[:m] + t] * (start if t == 0 else alpha[t - 1, :m] @ trans)
            s = a.sum(axis=1)
            alpha[t, :m], scale[t, :m] = a / s[:, None], s
            total += float(np.log(s).sum())
        beta = np.ones((len(f), k))
        for t in range(steps - 1, -1, -1):
            m = live[t]
            if t + 1 < steps and live[t + 1]:
                q = live[t + 1]
                onward = emit[f[:q] + t + 1] * beta[:q] / scale[t + 1, :q, None]
                pairs += (alpha[t, :q].T @ onward) * trans
                beta[:q] = onward @ trans.T
            posterior[f[:m] + t] = alpha[t, :m] * beta[:m]
        starts += posterior[f].sum(axis=0)
    return posterior, pairs, starts, total + float(top.sum())


def text_words(text: str | None) -> list[str]:
    words = _WORDS(text.lower()) if text else []
    if words and not "".join(words).isalpha():  # superscripts, fractions and the like are no letters
        words = [w for word in words for w in "".join(c if c.isalpha() else " " for c in word).split()]
    return words


def each_word(text: str) -> Iterator[str]:
    """The words of ``text_words``, one at a time."""
    for found in _EACH(text.lower()):
        word = found[0]
        if word.isalpha():
            yield word
        else:
            yield from "".join(c if c.isalpha() else " " for c in word).split()


def fit(texts: list[str], labels: list[str], rounds: int = 30, rate: float = 0.5, decay: float = 1e-4) -> Model:
    """Adaptive-gradient ascent of the conditional likelihood over all sample texts at once."""
    languages = sorted(set(labels))
    k = len(languages)
    if k < 2:
        return Model(languages, np.zeros((1, k), np.float32), np.zeros((k, k)), np.zeros(k), np.zeros(FEATURES, np.int32))
    label = np.array([languages.index(x) for x in labels])
    known: dict[str, int] = {}
    ids, counts = [], []
    for text in texts:
        words = text_words(text)
        ids += [known.setdefault(w, len(known)) for w in words]
        counts.append(len(words))
    ids, counts = np.array(ids, np.int64), np.array(counts, np.int64)
    slots = features(list(known))
    used = np.unique(slots[slots > 0])
    row_of = np.zeros(FEATURES, np.int32)
    row_of[used] = np.arange(1, len(used) + 1)
    slots = row_of[slots]
    model = Model(languages, np.zeros((len(used) + 1, k), np.float32), np.zeros((k, k)), np.zeros(k), row_of)
    # features word by word, and words feature by feature
    there = slots > 0
    mine, per_word = slots[there], there.sum(axis=1)
    word_heads = np.cumsum(per_word) - per_word
    order = np.argsort(mine, kind="stable")
    feature, word = mine[order], np.repeat(np.arange(len(known)), per_word)[order]
    _, first, length = chains(counts)
    text = np.repeat(np.arange(len(counts)), counts)
    truth = label[text]
    seen = np.bincount(ids * k + truth, minlength=len(known) * k).reshape(-1, k)
    inside = text[1:] == text[:-1]
    chain_head = np.zeros(len(ids), bool)
    chain_head[first] = True
    inside &= ~chain_head[1:]
    true_pairs = np.zeros((k, k))
    np.add.at(true_pairs, (truth[:-1][inside], truth[1:][inside]), 1)
    true_starts = np.bincount(truth[first], minlength=k)
    words = max(1, len(ids))
    squares = [np.full(model.weights.shape, 1e-8), np.full((k, k), 1e-8), np.full(k, 1e-8)]
    for _ in range(rounds):
        scores = np.add.reduceat(model.weights[mine], word_heads, axis=0).astype(np.float64)
        posterior, pairs, starts, _ = forward_backward(scores[ids], first, length, model)
        expected = np.stack([np.bincount(ids, posterior[:, c], len(known)) for c in range(k)], axis=1)
        slope = (seen - expected) / words
        gradient = np.zeros(model.weights.shape)
        for at in range(0, len(word), 1 << 18):
            part = feature[at : at + (1 << 18)]
            heads = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            gradient[part[heads]] += np.add.reduceat(slope[word[at : at + (1 << 18)]], heads, axis=0)
        steps = (gradient - decay * model.weights / words, (true_pairs - pairs) / words, (true_starts - starts) / words)
        for n, (value, step) in enumerate(zip((model.weights, model.transitions, model.start), steps, strict=True)):
            squares[n] += step * step
            value += (rate * step / np.sqrt(squares[n])).astype(value.dtype) * (0.2 if n else 1.0)
    return model


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """True for the rows whose crc32 of the id's text is 0 modulo ``folds``; they teach nothing."""
    return F.pmod(F.crc32(F.coalesce(named(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 0


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 800, least: int = 16, longest: int = 20_000) -> Model:
    """A model from the labelled rows that are not held out.  One row a language reaches the driver,
    then the sample."""
    own = docs.select(named(id_col).alias("id"), named(text_col).alias("text"), named(lang_col).alias("lang"), held_out(id_col).alias("out"))
    rows = own.where("lang is not null and not out and length(text) > 0").withColumn("short", F.length("text") <= longest)
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if("short").alias("short")).collect()
    if not sizes:
        return Model([], np.zeros((1, 0), np.float32), np.zeros((0, 0)), np.zeros(0), np.zeros(FEATURES, np.int32))
    share = max(least, sample // len(sizes))
    enough = share + 4 * share**0.5  # expected, so that hardly ever fewer than the share are found
    parts = [(r["lang"], min(1.0, enough / r["short"]) if r["short"] else min(1.0, least / 4 / r["n"]), r["short"] > 0) for r in sizes]
    # a row's place in [0, 1) by its id, compared with the share its language needs
    place = F.pmod(F.xxhash64(F.lit(7), F.col("id")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    wanted = F.broadcast(docs.sparkSession.createDataFrame(parts, "lang string, part double, only_short boolean"))  # one row a language
    chosen = rows.join(wanted, "lang").where((place < F.col("part")) & (F.col("short") | ~F.col("only_short")))
    taken = chosen.orderBy(F.xxhash64(F.lit(11), F.col("id")), "id").limit(2 * share * len(sizes)).select("text", "lang").collect()
    return fit([r[0] for r in taken], [r[1] for r in taken])


class Judge:
    """A task's judge of word lists: scores of the distinct words it met are kept, at most CACHE and one
    list's more."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, len(model.languages)), np.float32)

    def _learn(self, lists: list[list[str]]) -> None:
        if len(self.known) > CACHE:
            self.known.clear()
        new = list(set().union(*lists).difference(self.known))
        have, need = len(self.known), len(self.known) + len(new)
        if need > len(self.table):
            bigger = np.zeros((2 * need, self.table.shape[1]), np.float32)
            bigger[:have] = self.table[:have]
            self.table = bigger
        self.table[have:need] = self.model.word_scores(new)
        self.known.update(zip(new, range(have, need), strict=True))

    def sums(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each list the number of words, the sum of their posteriors, and of each word's greatest."""
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        by_language, greatest = np.zeros((len(lists), len(self.model.languages))), np.zeros(len(lists))
        if self.model.languages and counts.sum():
            self._learn(lists)
            get = self.known.__getitem__
            ids = np.fromiter((i for words in lists for i in map(get, words)), np.int64, int(counts.sum()))
            _, first, length = chains(counts)
            posterior, *_ = forward_backward(self.table[ids].astype(np.float64), first, length, self.model)
            there = np.flatnonzero(counts)
            heads = (np.cumsum(counts) - counts)[there]
            by_language[there] = np.add.reduceat(posterior, heads, axis=0)
            greatest[there] = np.add.reduceat(posterior.max(axis=1), heads)
        return counts, by_language, greatest

    def long_sums(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of one long text, whole chains of it at a time: what is held is its characters."""
        total = self.sums([[]])
        words = each_word(text)
        while section := list(itertools.islice(words, SECTION)):
            total = tuple(a + b for a, b in zip(total, self.sums([section]), strict=True))
        return total


def _predict(model: Model, names: list[str], chars_at_once: int = 1 << 18):
    """Rows (null, text, packed row) with language, score and evidence appended."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(model)
        for batch in batches:
            text = batch.column(1)
            sizes = np.cumsum(pc.fill_null(pc.utf8_length(text), 0).to_numpy(zero_copy_only=False))
            row = 0
            while row < batch.num_rows:
                done = sizes[row - 1] if row else 0
                stop = max(row + 1, int(np.searchsorted(sizes, done + chars_at_once, side="right")))
                if sizes[row] - done > chars_at_once:
                    counts, by_language, greatest = judge.long_sums(text[row].as_py())
                else:
                    counts, by_language, greatest = judge.sums([text_words(t) for t in text.slice(row, stop - row).to_pylist()])
                langs: list[str] = [UND] * (stop - row)
                scores, sure = np.zeros(stop - row), np.zeros(stop - row)
                there = np.flatnonzero(counts) if model.languages else np.zeros(0, np.int64)
                if len(there):
                    mean = by_language[there] / counts[there, None]
                    sure[there] = np.clip(greatest[there] / counts[there], 0, 1)
                    best = mean.argmax(axis=1)
                    for r, b in zip(there.tolist(), best.tolist(), strict=True):
                        langs[r] = model.languages[b]
                    scores[there] = np.clip(mean[np.arange(len(there)), best], 0, 1)
                yield pa.RecordBatch.from_arrays([*(c.slice(row, stop - row) for c in batch.columns), pa.array(langs, pa.string()), pa.array(scores), pa.array(sure)], names=names)
                row = stop

    return run


def identify(docs: DataFrame, model: Model, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score", sure_name: str | None = None) -> DataFrame:
    """``docs`` with the predicted language and its score appended, and as ``sure_name`` the mean of
    each word's own greatest posterior, which does not fall where a text switches languages."""
    others = [f for f in docs.schema.fields if f.name != text_col]
    safe = [f"c{k}" for k in range(len(others))]
    rows = docs.select(F.lit(None).cast("int").alias("none"), named(text_col).alias("text"), *[named(f.name).alias(n) for f, n in zip(others, safe, strict=True)])
    fields = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in rows.schema.fields)
    names = [*rows.columns, "found", "score", "sure"]
    found = rows.mapInArrow(frugal(_predict(model, names)), f"{fields}, found string, score double, sure double")
    held = {text_col: "text", **{f.name: n for f, n in zip(others, safe, strict=True)}}
    out = [F.col(held[c]).alias(c) for c in docs.columns] + [F.col("found").alias(lang_name), F.col("score").alias(score_name)]
    return found.select(*out, *([F.col("sure").alias(sure_name)] if sure_name else []))
