"""Each operator against a brute-force version and on odd tables."""

import hashlib
import itertools
import random
import re
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cellflux.llm import privacy, wrappers
from cellflux.llm.components import components
from cellflux.llm.count_rtree import CountRTree, Points, group_counts
from cellflux.llm.decontaminate import contamination
from cellflux.llm.exact_dedup import exact_dedup, keep_one
from cellflux.llm.jaccard_join import jaccard_components, keep_least
from cellflux.llm.language import Model, features, fit, forward_backward, held_out, identify, text_words, train
from cellflux.llm.packing import Cost, best_fit, pack, plan_bins, word_lengths
from cellflux.llm.quality import quality
from cellflux.llm.queries import ORACLES, QUERIES
from cellflux.llm.shared import in_bitmap, key_bitmap
from cellflux.llm.token_counts import RankMerger, token_counts
from cellflux.llm.urls import ADDRESS, Rule, domain_of, host_reputation, suffix_of, url_verdicts
from cellflux.llm.words import shingle_sets, words_of
from cellflux.llm.html_tree import parse
from cellflux.llm.wrappers import extract, infer_wrappers, main_text

SF = "/root/testdata/sf0.001"
random.seed(5)
WORDS = [a + b for a in "ka lo mi nu pe ri so tu".split() for b in "ba de fi go".split()]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def prose(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, a very long text, repeated rows and columns whose names clash with results."""
    base, long = prose(60), prose(60_000)
    rows = [
        (1, base, "en"), (2, base.upper(), "en"), (3, base + " extra", "en"), (3, base + " extra", "en"), (None, base, None), (None, None, None), (4, None, "en"), (5, "", "de"), (6, "  \n\t", "de"),
        (7, "kaba", "en"), (8, "KABA", None), (9, long, "en"), (10, long + " tail", "en"), (11, "x" * 200_000, "de"), (12, "1234 !!", "de"), (15, "½ ² ① 3", "de"), (16, "²a b", None), (13, "straße ÄÖ " + prose(30), "de"), (14, prose(80), "de"),
    ]
    extra = [(i, t, lang, "src", 7, "z", 0.5, 1, True, "h", "k", 3) for i, t, lang in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, length long, keep_id string, score double, key long, kept boolean, host string, id string, n int")


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


ODD_NAMES = ["__lang", "__score", "__none", "a.b", "c`d", "piece", "length", "bin_id", "__length", "row", "state", "own", "half", "e.f`g"]


@pytest.fixture(scope="module")
def named_oddly(spark):
    """A table whose columns have names that clash, hold dots or backticks, and the same with the id
    and text columns named so."""
    rows = [(k % 5, f"{prose(12)} mail{k}@x.example.org" if k % 4 else None, *["z"] * len(ODD_NAMES)) for k in range(12)]
    fields = ", ".join(f"`{n.replace('`', '``')}` string" for n in ODD_NAMES)
    plain = spark.createDataFrame(rows, f"doc_id long, text string, {fields}")
    return plain, plain.toDF("i.d`x", "te.xt`", *ODD_NAMES)


def test_odd_names(spark, named_oddly):
    import public_tokenizers

    plain, odd = named_oddly
    path, bench = str(public_tokenizers.path("byte_bpe_50k.json")), spark.createDataFrame([(1, prose(12))], "`item.id` long, `te.xt` string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "`d.id` long, `q.x` int")
    for docs, i, t in ((plain, "doc_id", "text"), (odd, "i.d`x", "te.xt`")):
        names, n = docs.columns, docs.count()
        model = train(docs, i, t, "a.b")
        found = identify(docs, model, t, "lang.found", "sc`ore", "su.re")
        assert found.columns == [*names, "lang.found", "sc`ore", "su.re"] and len(found.collect()) == n
        assert exact_dedup(docs, i, t).columns[0] == i and exact_dedup(docs, i, t).count() == n
        one = keep_one(docs, i, t)
        assert one.columns == names and len(one.collect()) == 10
        assert len(jaccard_components(docs, id_col=i, text_col=t).collect()) == n
        least = keep_least(docs, id_col=i, text_col=t)
        assert least.columns == names and 9 < len(least.collect()) <= n
        for hit in (False, True):
            marked = contamination(docs, bench, text_col=t, item_col="item.id", item_text_col="te.xt", result="re.sult`", drop_hit=hit)
            assert marked.columns == [*names, "re.sult`"] and len(marked.collect()) == n
        assert len(privacy.personal_data(docs, i, t).collect()) == n
        counts = token_counts(docs, path, i, t)
        assert counts.columns[0] == i and len(counts.collect()) == n
        packed = best_fit(counts, i, "n_tokens")
        assert packed.columns[0] == i and len(packed.collect()) == n
        assert len(quality(docs, labels, i, t, "a.b", "c`d", "d.id", "q.x").collect()) == n
        assert len(extract(docs, i, "a.b", t).collect()) == n
        assert len(url_verdicts(docs, labels, (), i, t, "d.id", "q.x").collect()) == n
    for name in ("piece", "length", "bin_id", "__length"):
        sizes = spark.createDataFrame([(7, 3), (8, 0)], f"{name} long, n long")
        assert best_fit(sizes, name, "n").columns[0] == name and len(best_fit(sizes, name, "n").collect()) == 2


def test_one_id_with_several_texts(spark):
    """Near copies go, the other text of the same id stays; of repeated rows one stays."""
    a, b, c = prose(50), prose(50), prose(50)
    rows = [(1, a), (2, a + " more"), (2, b), (3, c), (3, c), (None, b + " x"), (None, None), (4, "")]
    stay = sorted((tuple(r) for r in keep_least(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert stay == sorted([(1, a), (2, b), (3, c), (None, None), (4, "")], key=repr)


def test_long_text_is_hashed_in_pieces():
    """50 MB of one text in bounded memory; words and hashes as those of its parts."""
    import tracemalloc

    from cellflux.llm import words as module

    unit = np.frombuffer((prose(3000) + " ").encode(), np.uint8)
    data = np.tile(unit, 50_000_000 // len(unit))
    tracemalloc.start()
    hashes, begin, end = module.hash_words(data, np.zeros(1, np.int64), module.NOT_BLANK)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    one = module.hash_words(unit, np.zeros(1, np.int64), module.NOT_BLANK)
    assert len(hashes) == 3000 * (len(data) // len(unit)) and (hashes.reshape(-1, 3000) == one[0]).all()
    assert (data[begin[1:] - 1] == 32).all() and peak < 14 * len(data)
    glued = np.full(3 * module.SLICE, 97, np.uint8)
    assert [x.tolist() for x in module.hash_words(glued, np.zeros(1, np.int64), module.NOT_BLANK)[1:]] == [[0], [len(glued)]]


def dedup_truth(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    return {t: (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


def test_exact_dedup(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    truth = dedup_truth(rows)
    sha = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in truth.items()}
    got = exact_dedup(odd, all_digests=True).collect()
    assert len(got) == len(rows)
    kept = {}
    for r in got:
        assert (r["keep_id"], r["group_size"]) == sha[r["digest"]]
        kept[r["digest"]] = kept.get(r["digest"], 0) + r["kept"]
    assert set(kept.values()) == {1}
    lazy = exact_dedup(odd).where("digest is null").collect()
    assert all(r["group_size"] == 1 and r["kept"] for r in lazy)
    stay = keep_one(odd)
    assert stay.columns == odd.columns and stay.count() == len(truth)
    assert exact_dedup(none).count() == 0 and keep_one(none).count() == 0


def jaccard_truth(rows, size, num, den):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    part = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            x, y = part[a], part[b]
            part = [min(x, y) if p in (x, y) else p for p in part]
    least = {p: min((rows[k][0] for k in range(len(rows)) if part[k] == p and rows[k][0] is not None), default=None) for p in set(part)}
    return sorted(((rows[k][0], len(sets[k]), least[part[k]] if sets[k] else rows[k][0]) for k in range(len(rows))), key=repr)


@pytest.mark.parametrize(("size", "num", "den"), [(4, 85, 100), (5, 4, 5), (2, 1, 2)])
def test_jaccard_join(spark, odd, none, size, num, den):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = [tuple(r) for r in jaccard_components(odd, size, num, den).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=repr) == jaccard_truth(rows, size, num, den)
    assert jaccard_components(none, size, num, den).count() == 0


def near_copies(n, change):
    """A cluster of near copies, and unrelated texts that all have one common passage."""
    base, common = prose(150).split(), prose(40)
    out = []
    for k in range(n):
        words = list(base)
        for p in random.sample(range(150), change):
            words[p] = random.choice(WORDS) + str(k % 7)
        out.append(" ".join(words))
    return out + [f"{prose(30)} {common} {prose(30)}" for _ in range(n)] + [prose(random.randint(1, 12)) for _ in range(60)]


@pytest.mark.parametrize("change", [1, 2, 3])
def test_large_groups_of_near_copies(spark, change):
    rows = list(enumerate(near_copies(70, change)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in jaccard_components(docs, 4, 85, 100).select("doc_id", "n_shingles", "component_id").collect()]
    truth = jaccard_truth(rows, 4, 85, 100)
    assert sorted(got, key=repr) == truth
    stay = keep_least(docs, 4, 85, 100)
    assert {r["doc_id"] for r in stay.collect()} == {i for i, _, c in truth if i == c}


def test_tree_loses_no_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 50, 300, dtype=np.uint64)
    sets = []
    for _ in range(150):
        keep = rng.random(300) < 0.95
        sets.append(np.unique(np.concatenate([base[keep], rng.integers(0, 1 << 50, int(rng.integers(0, 30)), dtype=np.uint64)])))
    n = np.array([len(s) for s in sets])
    offsets = np.append(0, np.cumsum(n))
    for finer in (1, 8):
        body, begin, excess = group_counts(np.concatenate(sets), offsets, finer)
        points = Points([body[a:b].tobytes() for a, b in itertools.pairwise(begin.tolist())], excess, n, np.arange(150), 85, 100)
        found = set()
        for bits in np.unique(points.bits).tolist():
            x, y = CountRTree(points, np.flatnonzero(points.bits >= bits), bits).pairs()
            found |= {(min(p), max(p)) for p in zip(x.tolist(), y.tolist(), strict=True)}
        for a, b in itertools.combinations(range(150), 2):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 85 * (n[a] + n[b] - both):
                assert (a, b) in found


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 200), (200, 150), (7, 7)] + [(1000, k) for k in range(1001, 1100)]
    random.shuffle(edges)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, 150: 100, 200: 100, **{k: 1000 for k in range(1001, 1100)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bitmap(spark):
    keys = [5, -7, 1 << 40, 123456789]
    bits = key_bitmap(spark.createDataFrame([(k,) for k in keys], "k long"), "k", 2)
    assert in_bitmap(bits, np.array(keys)).all() and not in_bitmap(bits, np.array([6, 8, 11])).any()


def test_shingles_do_not_depend_on_slices(monkeypatch):
    import pyarrow as pa

    from cellflux.llm import words as module

    texts = pa.array([prose(random.randint(0, 40)) for _ in range(50)] + [None, "", "a"])

    def sets():
        out = []
        for w in words_of(texts):
            value, at = shingle_sets(w, 3)
            out += [value[a:b].tolist() for a, b in itertools.pairwise(at.tolist())]
        return out

    whole = sets()
    monkeypatch.setattr(module, "SLICE", 37)
    assert sets() == whole


def contamination_truth(docs, items, window):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, t in items:
        w = pattern.findall(lower(t))
        for k in range(max(1, len(w) - window + 1) if w and i is not None else 0):
            windows.setdefault(tuple(w[k : k + window]), set()).add(str(i))
    out = []
    for i, t in docs:
        w = pattern.findall(lower(t))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [None, 7])
def test_decontamination(spark, odd, none, block):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    text = docs[0][1].split()
    items = [(1, " ".join(text[5:30])), (2, " ".join(text[20:33]).upper()), (3, "kaba"), (4, "kaba"), (5, None), (6, ""), (None, "lode"), (7, "straße äö"), (8, prose(20)), (9, text[3] + " " + text[4]), (1, " ".join(text[5:30]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = contamination(odd, bench, window=10, block_windows=block)
    assert got.columns == [*odd.columns, "contamination"]
    rows = [(r["doc_id"], r["contamination"]["n_words"], sum(h["end"] - h["start"] for h in r["contamination"]["hits"]), r["contamination"]["items"]) for r in got.collect()]
    assert sorted(rows, key=repr) == contamination_truth(docs, items, 10)
    clean = contamination(odd, bench, window=10, block_windows=block, drop_hit=True)
    assert clean.count() == sum(1 for r in rows if not r[2])
    assert contamination(none, bench).count() == 0
    assert {r["contamination"]["n_words"] > 0 for r in contamination(odd, bench.where("false")).collect()} == {True, False}


def test_token_counts(spark, odd, none):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    judge = Tokenizer.from_file(path)
    texts = ["", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "aaaaaaaaaaa" * 9, "  \n\n  x", "日本語😀é" * 20, "=" * 3000, "I'll it's 123", "\x00 \x01"]
    texts += ["".join(random.choice("ab aé\n'=1st日") for _ in range(random.randint(0, 200))) for _ in range(300)]
    assert RankMerger(path).counts(texts) == [len(e.ids) for e in judge.encode_batch(texts, add_special_tokens=False)]
    rows = odd.select("doc_id", "text").collect()
    truth = sorted([(r["doc_id"], len((r["text"] or "").encode()), len(judge.encode(r["text"] or "", add_special_tokens=False).ids)) for r in rows], key=repr)
    assert sorted([tuple(r) for r in token_counts(odd, path, chars_at_once=1000).collect()], key=repr) == truth
    assert token_counts(none, path).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_truth(text):
    out = []
    for k, (name, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            bad = name == "ip" and any(int(p) > 255 for p in m[0].split(".")) or name == "card" and not (14 <= len(digits) <= 19 and privacy.luhn(digits)) or name == "phone" and not 10 <= len(digits) <= 15
            if not bad:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans():
    texts = ["a@b@c.de x@y.z@w.v @a.b ..@x.y", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.4 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111", "+1 (555) 010-9999 +49 30 1234567 +1 23", "+" + "(" * 2000 + "1", "9" * 5000]
    texts += ["".join(random.choice("ab1.2@+ -(45é") for _ in range(80)) for _ in range(3000)]
    texts += ["".join(random.choice("0123456789 -") for _ in range(60)) for _ in range(2000)]
    for t in texts:
        assert privacy.base_spans(t) == base_truth(t)


def test_personal_data(spark, odd, none):
    secret = [(100 + k, f"{prose(12)} quarzheim agent {k % 4}@spy.example.org {prose(12)}") for k in range(40)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(secret, "doc_id long, text string"))
    found = privacy.personal_data(docs, generalise_at=0.8, remove_at=0.95).collect()
    assert len(found) == docs.count()
    terms = {r["doc_id"]: [s for s in r["spans"] if s["kind"] == privacy.TERM] for r in found}
    text = dict(secret)
    named = [text[i][s["start"] : s["end"]] for i, spans in terms.items() if i in text for s in spans]
    assert {"quarzheim", "agent"} <= set(named) and not set(named) & set(WORDS)
    out = privacy.sanitised(docs.where("doc_id >= 100"), privacy.personal_data(docs, generalise_at=0.8, remove_at=0.95)).collect()
    assert all("@" not in r["text"] and "[EMAIL]" in r["text"] and "quarzheim" not in r["text"] for r in out)
    assert privacy.personal_data(odd).count() == odd.count() and privacy.personal_data(none).count() == 0


def test_personal_data_query_counts_each_kind(spark, tmp_path):
    random.seed(3)
    parts = ["a@b.example", "1.2.3.4", "4111 1111 1111 1111", "+1 (555) 010-9999", "256.1.1.1", "4111 1111 1111 1112", "é", "kaba"]
    texts = [None, "", "no data", *parts, "1.2.3.4 " * 5, "+1 (555) 010-9999, a@b.example; 1.2.3.4", "a@b.example,c@d.example"]
    texts += [", ".join(random.choices(parts, k=random.randint(2, 9))) for _ in range(40)]
    rows = list(enumerate(texts)) + [(None, "1.2.3.4"), (3, "4111 1111 1111 1111")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    truth = []
    for i, text in rows:
        base = base_truth(text)
        told = ",".join(f"{privacy.KINDS[k]}:{a}:{b}" for a, k, b in base)
        truth.append((i, *(sum(k == n for _, k, _ in base) for n in range(4)), hashlib.sha256(told.encode()).hexdigest()))
    got = QUERIES["op3_personal_data"](spark, str(tmp_path)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    assert [t for _, t in got.dtypes] == ["bigint"] * 5 + ["string"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, truth))


def test_disclosive_terms_are_marked_everywhere(spark):
    """Production parameters; name at the head, address at the foot, names of two letters and in CJK,
    and occurrences in documents without the address."""
    rows = [(k, f"Vo Quillmark 山田太郎 {prose(60)} mail one@spy.example.org") for k in range(3)]
    rows += [(3, f"{prose(40)} quillmark {prose(10)} VO 山田太郎"), (4, f"Quillmark {prose(50)}")]
    rows += [(10 + k, prose(400)) for k in range(100)]
    found = privacy.personal_data(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    text = dict(rows)
    named = {r["doc_id"]: sorted(text[r["doc_id"]][s["start"] : s["end"]].lower() for s in r["spans"] if s["kind"] == privacy.TERM) for r in found}
    for k in range(3):
        assert set(named[k]) == {"mail", "quillmark", "vo", "山田太郎"}
    assert named[3] == ["quillmark", "vo", "山田太郎"] and named[4] == ["quillmark"]
    assert not any(named[10 + k] for k in range(100))


def test_words_outside_spans(spark):
    """Every word a term: those kept are the ones that no base span touches; the work grows with a text's
    words and spans, not with their product (16,000 spans took two minutes)."""
    random.seed(8)
    texts = [None, "", "+4111111111111111 a@b.c,1.2.3.4 x", "1." * 64_000]
    texts += ["".join(random.choice(["a", "1", "2.3.4.5", "a@b.cd", " ", ".", "+", "-", "4111111111111111", "+12025550123", "é"]) for _ in range(60)) for _ in range(500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    schema = "row long, id long, base array<struct<start:int,kind:int,end:int>>, hits array<struct<term:long,start:int,end:int>>"
    begun = time.perf_counter()
    got = {r["id"]: [(h["start"], h["end"]) for h in r["hits"]] for r in docs.mapInArrow(privacy._scan(np.full(1 << 20, 255, np.uint8)), schema).collect()}
    assert time.perf_counter() - begun < 60
    assert got.pop(3) == []
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    for i, found in got.items():
        base = base_truth(texts[i])
        assert found == [m.span() for m in word.finditer(texts[i] or "") if all(m.end() <= a or m.start() >= b for a, _, b in base)]


def shares_truth(texts, min_support, at):
    """Shares of the pairs of an entity and a word, counted plainly."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    total, counts, mentions, near, rows, docs_of = 0, {}, {}, {}, {}, {}
    for text in texts:
        own = [w for w in word.findall(lower(text))]
        total += len(own)
        found = [privacy.entity_key(k, text[a:b]) for a, k, b in base_truth(text)] if text else []
        for w in own:
            counts[w] = counts.get(w, 0) + 1
        for e in found:
            mentions[e] = mentions.get(e, 0) + 1
        for e in set(found):
            docs_of[e] = docs_of.get(e, 0) + 1
            for w in own:
                near[e, w] = near.get((e, w), 0) + 1
            for w in set(own):
                rows[e, w] = rows.get((e, w), 0) + 1
    out = {}
    for (e, w), n in near.items():
        if docs_of[e] >= 2 and n >= min_support and rows[e, w] >= 2:
            share = 1 + np.log(n / counts[w]) / -np.log(min(0.5, mentions[e] / total))
            if share >= at:
                out[e, w] = share
    return out


def test_disclosure_shares(spark):
    random.seed(11)
    people = [f"agent{k}@spy.example.org" for k in range(5)] + ["+49 30 555 0100 7", "10.20.30.40"]
    texts = [f"{prose(30)} {'zorn' if k % 3 else prose(1)} {random.choice(people)} {prose(5)} tag{k % 9} {random.choice(people) if k % 4 == 0 else ''}" for k in range(120)]
    texts += [prose(50) + f" tag{k % 9}" for k in range(60)] + [None, ""]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    truth = shares_truth(texts, 3, 0.2)
    got = privacy.disclosive_terms(docs, "text", 3, 0.2).collect()
    assert len(got) == len(truth) > 50
    assert sorted((r["entity"], r["share"]) for r in got) == [(e, pytest.approx(s)) for e, s in sorted((e, s) for (e, _), s in truth.items())]


def test_word_counts_grow_with_the_input_only(monkeypatch):
    """What a task hands on is its distinct counted words, whatever the number of its slices."""
    import pyarrow as pa

    from cellflux.llm import words as module

    texts = pa.array([prose(500) for _ in range(40)])
    keys = np.concatenate([w.hashes for w in words_of(texts, module.ALNUM)]).view(np.int64)
    full = np.full(1 << 17, 255, np.uint8)
    sizes = []
    for size in (1 << 19, 997):
        monkeypatch.setattr(module, "SLICE", size)
        out = list(privacy._count_words(full)(iter([pa.RecordBatch.from_arrays([texts], names=["text"])])))
        sizes.append(sum(b.num_rows for b in out))
        assert sum(b.column(1).to_numpy().sum() for b in out) == len(keys)
    assert sizes == [len(np.unique(keys))] * 2


def test_main_text(spark):
    page = (
        '<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href=x>Menu</a></li></ul></nav><!-- c <p>x</p> --><div class="ad">Buy</div>'
        "<article><h1>Head &amp; {0}</h1><p><b>One<br>two&nbsp;{0}</p><p>three</p><aside>side</aside><form>f<input></form><div class='comments'><p>bad</p></div></article><footer>&copy; f</footer></body></html>"
    )
    expected = "Head & {0} One two {0} three"
    plain = "<div id=menu><a href=x>a b</a></div><div class=content><h2>T{0}</h2><p>p1 {0}<p>p2 of some length {0}</div><section id=comments>bad</section>"
    rows = [(k, f"http://h{k % 2}.example.org/{k}", page.format(k) if k % 2 else plain.format(k)) for k in range(12)]
    rows += [(20, None, page.format(7)), (21, "http://n.example.org/", None), (22, "http://n.example.org/", ""), (23, "x", "<p>" * 500 + "deep" + "<table><tr><td>a<td>b"), (24, "y", "plain < text"), (1, "http://h1.example.org/1", page.format(1))]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in extract(pages).collect()}
    assert len(rows) == extract(pages).count()
    for k in range(12):
        assert got[k] == (expected.format(k) if k % 2 else f"T{k} p1 {k} p2 of some length {k}")
    assert (got[20], got[21], got[22], got[23], got[24]) == (expected.format(7), "", "", "deep a b", "plain < text")
    assert extract(pages.where("false")).count() == 0
    one = infer_wrappers(pages.repartition(1)).collect()
    many = infer_wrappers(pages.repartition(9)).collect()
    assert sorted((r["host"], r["pages"]) for r in one) == sorted((r["host"], r["pages"]) for r in many)
    assert main_text(None, None) == ""


NEUTRAL = {"<nav>": "<div>", "</nav>": "</div>", '<div class="ad">': "<div>", "<article>": "<div>", "</article>": "</div>", "<footer>": "<div>", "</footer>": "</div>"}


def test_wrappers_find_the_article_without_its_tags(spark):
    """The same pages with every telling tag made a plain div: the host's wrapper still finds the text,
    which a page alone does not always tell."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").where("page_id < 1000")
    plain = F.col("html")
    for tag, div in NEUTRAL.items():
        plain = F.replace(plain, F.lit(tag), F.lit(div))
    truth = {r["page_id"]: r["text"] for r in extract(pages).collect()}
    got = {r["page_id"]: r["text"] for r in extract(pages.withColumn("html", plain)).collect()}
    assert got == truth and all(truth.values())
    alone = [main_text(r["html"], None) for r in pages.withColumn("html", plain).orderBy("page_id").collect()]
    assert 0 < sum(a != truth[k] for k, a in enumerate(alone)) < 100


def test_paragraphs_shared_by_pages_stay(spark):
    shared = "This paragraph about the licence stands in every article of the host and belongs to it."
    page = "<body><div class=top><ul><li><a href=x>Home</a><li>yes<li>yes</ul></div><div class=text><h1>Title {0}</h1><p>By {0}</p><p>" + shared + "</p><ul><li>yes</li><li>yes</li><li>yes</li><li>yes</li></ul><p>{1}</p>"
    page += "<div class=social-history><p>The social history of {0}.</p></div><div class=related-work>Earlier work on {0}.</div></div><div class=foot>All rights of the host are reserved by the host, as always.</div></body>"
    bodies = [prose(40 + k) for k in range(6)]
    rows = [(k, f"http://one.example.org/{k}", page.format(k, bodies[k])) for k in range(6)]
    got = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Title {k} By {k} {shared} yes yes yes yes {bodies[k]} The social history of {k}. Earlier work on {k}." for k in range(6)}
    banner = "<body><div class=banner><h1>Head</h1></div><div class=x><p>body text of the page</p><div class=ads>buy</div></div></body>"
    assert main_text(banner, None) == "Head body text of the page"


def alignment_truth(a, b):
    if not a or not b:
        return 0
    own = wrappers._weight(a[0], b[0])
    return max(alignment_truth(a[1:], b), alignment_truth(a, b[1:]), own + alignment_truth(a[1:], b[1:]) if own else 0)


def test_alignment_is_the_heaviest(monkeypatch):
    def element():
        return [random.choice("abc"), "", [[random.choice("xyz"), "", [], 1] for _ in range(random.randint(0, 3))], 1]

    for _ in range(300):
        a, b = ([element() for _ in range(random.randint(0, 6))] for _ in range(2))
        found = wrappers._matches(a, b)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(found))
        assert sum(wrappers._weight(a[i], b[j]) for i, j in found) == alignment_truth(a, b)
    # long lists of different elements are aligned at those that occur once in each
    wide = ["".join(f"<div class='{c * k}'>t{k}</div>" for k in range(1, 700)) for c in "pq"]
    both = wrappers._joined(*(wrappers.wrapper_of(parse("<body><h1>x</h1>" + w + "<h2>y</h2>")) for w in wide), True)
    names = [x[0] for x in both[2][0][2]]
    assert len(names) <= wrappers.MOST_CHILDREN and names[0] == "h1" and names[-1] == "h2"


@pytest.mark.parametrize("limit", [None, 0])
def test_regions_reach_pages_by_either_join(spark, limit):
    regions = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2"), ("d", "3")], "host string, region string")
    rows = spark.createDataFrame([(k, "u", "h", "abcd"[k % 4]) for k in range(40)], "id long, url string, html string, host string")
    got = {r["id"]: r["region"] for r in wrappers.with_regions(rows, regions, limit).collect()}
    assert got == {k: "1123"[k % 4] for k in range(40)}


def test_urls(spark):
    rules = (Rule("block", "net"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))
    urls = ["http://A.Example.NET/en/1?x", "http://example.net/de", "https://net", "http://x.net/", "http://b.example.com/de/#t", "http://notexample.com/de/", "http://q.org/fr/://z", "noscheme/de/", None, "http://bad.example.com/x"]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)] + [(100 + k, f"http://bad.example.com/{k}", "h") for k in range(60)], "page_id long, url string, host string")
    labels = spark.createDataFrame([(100 + k, 1) for k in range(60)] + [(k, 0) for k in range(4)] + [(5, None)], "page_id long, bad int")
    got = {r["page_id"]: r for r in url_verdicts(pages, labels, rules).collect()}
    assert [got[k]["rule"] for k in range(10)] == ["example.net/en/", "net/", None, "net/", "example.com/de/", None, "org/fr/", None, None, None]
    assert [got[k]["verdict"] for k in (0, 1, 3, 4, 6, 9)] == ["allow", "block", "block", "block", "allow", "block"]
    assert (got[0]["host"], got[0]["path"], got[2]["path"], got[8]["host"]) == ("a.example.net", "/en/1", "", "")
    assert url_verdicts(pages, labels.where("false"), rules).where("verdict = 'block' and rule is null").count() == 0
    assert url_verdicts(pages.where("false"), labels, rules).count() == 0
    few = spark.createDataFrame([("a.x.org", 1)] + [("b.x.org", int(k % 10 == 0)) for k in range(200)], "host string, bad int")
    known = {(r["level"], r["name"]): r["mean"] for r in host_reputation(few).collect()}
    assert known["host", "b.x.org"] < known["host", "a.x.org"] < 0.6  # one bad page is shrunk towards its domain


def test_suffixes_and_domains(spark):
    hosts = {
        "a.b.example.org": ("org", "example.org"), "www.shop.co.uk": ("co.uk", "shop.co.uk"), "x.gov.au": ("gov.au", "x.gov.au"), "10.0.0.7": (ADDRESS, "10.0.0.7"), "10.0.0.7:80": (ADDRESS, "10.0.0.7"),
        "u@a.example.com:8080": ("com", "example.com"), "[::1]": (ADDRESS, "[::1]"), "localhost": ("localhost", "localhost"), "": ("", ""),
    }
    rows = spark.createDataFrame([(h,) for h in hosts], "host string").select("host", suffix_of(F.col("host")).alias("s"), domain_of(F.col("host")).alias("d")).collect()
    assert {r["host"]: (r["s"], r["d"]) for r in rows} == hosts


def test_reputation_against_sql(spark, tmp_path):
    """Hosts whose pages are bad, addresses, double suffixes and null labels."""
    kinds = [("bad.example.com", 0.95), ("www.bad.example.com", 0.9), ("good.example.com", 0.05), ("shop.co.uk", 0.9), ("news.co.uk", 0.9), ("fine.org.uk", 0.1), ("10.0.0.7", 0.95), ("10.9.9.7", 0.05), ("few.example.org", 0.5)]
    pages, labels = [], []
    for k in range(900):
        host, rate = kinds[k % len(kinds)]
        pages.append((k, f"http://{host}/en/{k}.html", "h"))
        bad = random.random() < rate
        labels.append((k, None if k % 10 == 3 else int(not bad), None if k % 7 == 2 else int(bad and k % 2)))
    pages += [(900 + k, f"http://{h}/none", "h") for k, h in enumerate(["new.co.uk", "10.1.1.1", "new.bad.example.com", "unseen.example", "x.org.uk"])]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for table in ("pages", "labels"):
        con.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    truth = {r[0]: r[1:] for r in con.execute(f"select page_id, host, path, rule, verdict from ({ORACLES['op5_url_filter']})").fetchall()}
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in QUERIES["op5_url_filter"](spark, str(tmp_path)).collect()}
    assert got == truth
    blocked = {v[0] for v in got.values() if v[3] == "block"}
    assert {"bad.example.com", "www.bad.example.com", "shop.co.uk", "10.0.0.7"} <= blocked and not blocked & {"good.example.com", "10.9.9.7", "fine.org.uk"}


def test_url_labels_belong_to_the_document_carried(spark, tmp_path):
    ends = ["", ".html", "/", "?page=2&ref=9", "#top7", "?utm_source=feed"]
    pages = [(k, f"http://{'bad' if k % 2 else 'good'}.example.com/en/{1000 + k}{ends[k % 6]}", "h") for k in range(80)]
    pages += [(80, "http://good.example.com/en/about", "h"), (81, None, "h"), (1000, "http://good.example.com/en/1000", "h")]
    labels = [(1000 + k, 1 - k % 2, 0) for k in range(80)] + [(k, k % 2, 0) for k in range(80)]  # ids of pages are other documents
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["page_id"]: r["verdict"] for r in QUERIES["op5_url_filter"](spark, str(tmp_path)).collect()}
    assert len(got) == len(pages)
    assert all(got[k] == ("block" if k % 2 else "allow") for k in range(80)) and got[80] == got[81] == got[1000] == "allow"


def test_language(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = train(docs)
    found = identify(docs, model).withColumn("held", held_out()).where("held").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.95
    got = identify(odd, model, score_name="how_sure").collect()
    assert len(got) == odd.count()
    assert all((r["lang_pred"] == "und") == (not any(map(str.isalpha, r["text"] or ""))) and 0 <= r["how_sure"] <= 1 for r in got)
    assert identify(none, model, score_name="s2").count() == 0
    untaught = train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in identify(docs, untaught).collect()} == {"und"}
    alone = train(docs.where("lang = 'de'"))
    assert {r["lang_pred"] for r in identify(docs.where("text rlike '[a-z]'"), alone).collect()} == {"de"}


def test_long_texts_are_judged_in_whole_chains(monkeypatch):
    """Sections of a text give what the text gives at once, odd letters and cut words included."""
    import pyarrow as pa

    from cellflux.llm import language

    rng = random.Random(5)
    words = {"a": ["ala", "kot", "ma", "psa"], "b": ["the", "dog", "cat", "has"]}
    model = fit([" ".join(rng.choices(words[x], k=30)) for x in "ab" * 20], list("ab" * 20))
    texts = [" ".join(rng.choices(words["a"] + words["b"] + ["x²y", "½", "z" * 60, "12", "İŞ"], k=n)) for n in (1, 63, 64, 65, 700, 1000)] + ["", None, "½ 1", "kot"]
    batch = pa.RecordBatch.from_arrays([pa.nulls(len(texts), pa.int32()), pa.array(texts, pa.string())], names=["none", "text"])

    def judged(**limits):
        made = pa.Table.from_batches(language._predict(model, ["none", "text", "found", "score", "sure"], **limits)(iter([batch]))).to_pydict()
        assert made["text"] == texts
        return made["found"], np.array([made["score"], made["sure"]])

    found, numbers = judged()
    monkeypatch.setattr(language, "SECTION", 2 * language.CHAIN)
    assert [list(language.each_word(t)) for t in texts if t] == [text_words(t) for t in texts if t]
    for limit in (1, 50, 400, 3000):
        again, others = judged(chars_at_once=limit)
        assert again == found and np.allclose(others, numbers, rtol=0, atol=1e-12)


def test_every_language_is_learned(spark):
    """Many languages, one with long texts only; held-out rows and their languages teach nothing."""
    alphabets = [f"{chr(0x3B1 + 2 * k)}{chr(0x3B2 + 2 * k)}" for k in range(6)]
    rows = [(k, " ".join(random.choice(alphabets[k % 6]) * random.randint(2, 30) for _ in range(4000 if k % 6 == 5 else 20)), f"l{k % 6}") for k in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train(docs, sample=60, longest=2000)
    assert model.languages == [f"l{k}" for k in range(6)]
    assert np.mean([r["lang"] == r["lang_pred"] for r in identify(docs, model).collect()]) == 1
    taught = docs.withColumn("lang", F.when(held_out(), "never").otherwise(F.col("lang")))
    assert train(taught, sample=60, longest=2000).languages == model.languages
    assert [len(w) for w in text_words("a" * 60 + " bb")] == [24, 24, 12, 2] and text_words("x²y½ ①") == ["x", "y"]


def test_fit_against_plain_gradients():
    """One step of the fit against sums written plainly."""
    texts, labels = [prose(9), prose(7) + " x", "y z"], ["a", "b", "b"]
    model = fit(texts, labels, rounds=1, rate=1.0, decay=0.0)
    words = [w for t in texts for w in t.split()]
    truth = [x for t, x in zip(texts, labels, strict=True) for _ in t.split()]
    for w in set(words):
        for slot in features([w])[0]:
            if not slot:
                continue
            # before the first step every posterior is 1/2
            slope = sum(((x == "a") - 0.5) * sum(s == slot for s in features([v])[0]) for v, x in zip(words, truth, strict=True)) / len(words)
            got = model.weights[model.row_of[slot]]
            assert got[0] == pytest.approx(slope / np.sqrt(slope**2 + 1e-8), abs=1e-4) and got[1] == pytest.approx(-got[0], abs=1e-4)


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(1)
    model = Model(["a", "b", "c"], np.zeros((1, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    scores, first, length = rng.normal(size=(7, 3)), np.array([0, 4]), np.array([4, 3])
    posterior, _, _, total = forward_backward(scores, first, length, model)
    log_z = 0.0
    for f, n in zip(first, length, strict=True):
        weight = {p: model.start[p[0]] + sum(scores[f + k, p[k]] for k in range(n)) + sum(model.transitions[p[k - 1], p[k]] for k in range(1, n)) for p in itertools.product(range(3), repeat=n)}
        z = np.log(sum(np.exp(list(weight.values()))))
        log_z += z
        for k in range(n):
            for c in range(3):
                assert posterior[f + k, c] == pytest.approx(sum(np.exp(w - z) for p, w in weight.items() if p[k] == c))
    assert total == pytest.approx(log_z)


def test_quality(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    teach, test = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    found = quality(docs, teach).join(test, "doc_id").collect()
    assert np.mean([r["kept"] == (r["quality"] == 1) for r in found]) > 0.95
    assert quality(odd, teach).count() == odd.count() and quality(none, teach).count() == 0
    assert {r["p_quality"] for r in quality(odd, teach.where("false")).collect()} == {0.5}


def test_quality_leaves_own_labels_out(spark):
    """Posteriors of paths and sites against counts written plainly, without the document's own label."""
    random.seed(8)
    rates = {("s1", "a"): 0.9, ("s1", "b"): 0.2, ("s2", "a"): 0.5, ("s2", None): 0.7, (None, "a"): 0.4}
    rows = [(k, prose(20), *random.choice(list(rates))) for k in range(400)] + [(900, prose(5), "new", "a"), (901, prose(5), "s1", "new"), (None, "x y", "s1", "a")]
    labels = [(k, int(random.random() < rates[s, p])) for k, _, s, p in rows[:300]] + [(5, None), (950, 1)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality(docs, known).collect()}
    good = {k: y for k, y in labels if y is not None and k < 900}
    mine = [(s, p, good[k]) for k, _, s, p in rows if k in good]

    def strength(members, mean):
        big = [(len(g), sum(g), mean(key)) for key, g in members.items() if len(g) > 1]
        extra = sum(n * (n - 1) * m * (1 - m) for n, _, m in big)
        rho = (sum((b - n * m) ** 2 for n, b, m in big) - sum(n * m * (1 - m) for n, _, m in big)) / extra
        return 1 / min(0.999, max(1e-4, rho)) - 1

    def grouped(keys):
        out = {}
        for x in keys:
            out.setdefault(x[:-1] if len(x) > 2 else x[0], []).append(x[-1])
        return out

    rate = (sum(y for *_, y in mine) + 0.5) / (len(mine) + 1)
    sites, paths = grouped([(s, y) for s, _, y in mine]), grouped(mine)
    by_site = strength(sites, lambda _: rate)
    by_path = strength(paths, lambda key: (sum(sites[key[0]]) + by_site * rate) / (len(sites[key[0]]) + by_site))
    for k, _, s, p in rows:
        own = [good[k]] if k in good else []
        n, g = len(sites.get(s, [])) - len(own), sum(sites.get(s, [])) - sum(own)
        at_site = (g + by_site * rate) / (n + by_site)
        n, g = len(paths.get((s, p), [])) - len(own), sum(paths.get((s, p), [])) - sum(own)
        truth = (g + by_path * at_site) / (n + by_path)
        assert got[k]["p_site"] == pytest.approx(truth)
        odds = np.log(got[k]["p_document"] / (1 - got[k]["p_document"])) + np.log(truth / (1 - truth)) - np.log(rate / (1 - rate))
        assert got[k]["p_quality"] == pytest.approx(1 / (1 + np.exp(-odds)), rel=1e-6)


def pack_truth(lengths, capacities, cost):
    """The same rules, written plainly."""
    order = sorted(range(len(lengths)), key=lambda k: (-lengths[k], k))
    rooms, used, chosen = [], [], {}
    for at, k in enumerate(order):
        size = lengths[k]
        fits = [(rooms[b], -b) for b in range(len(rooms)) if rooms[b] >= size]
        if fits:
            b = rooms.index(min(fits)[0])  # bins of equal room are alike
        else:
            rest = [lengths[j] for j in order[at + 1 :]]
            b = len(rooms)
            best = min(capacities, key=lambda c: (cost.of(c) / (size + min(c - size, sum(x for x in rest if x <= c - size))), c) if c >= size else (float("inf"), c))
            rooms.append(best)
            used.append(0)
        chosen[k] = b
        used[b] += size
        rooms[b] -= size
    return sorted(used), sorted(min(c for c in capacities if c >= u) for u in used)


def test_packing(spark, odd, none):
    rng = np.random.default_rng(2)
    for _ in range(20):
        lengths = rng.integers(1, 65, 60)
        bins, offsets, final = pack(lengths, (16, 32, 64))
        used = np.bincount(bins, lengths)
        assert (sorted(used.tolist()), sorted(final.tolist())) == pack_truth(lengths.tolist(), (16, 32, 64), Cost())
        for b in range(len(final)):  # pieces lie one after the other
            mine = np.flatnonzero(bins == b)
            mine = mine[np.argsort(offsets[mine])]
            assert (offsets[mine] == np.cumsum(lengths[mine]) - lengths[mine]).all()
    sizes = word_lengths(odd)
    got = best_fit(sizes, "doc_id", "n_words").collect()
    per_doc = {}
    for r in got:
        per_doc[r["doc_id"]] = per_doc.get(r["doc_id"], 0) + r["length"]
        assert (r["bin_id"] is None) == (r["length"] == 0)
    truth = {}
    for r in odd.collect():
        truth[r["doc_id"]] = truth.get(r["doc_id"], 0) + len((r["text"] or "").split())
    assert per_doc == truth
    assert best_fit(word_lengths(none), "doc_id", "n_words").count() == 0


def test_packing_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(4)
    lengths = np.minimum(20_000, rng.lognormal(5.5, 1.4, 6_000).astype(int) + 1).tolist()
    rows = spark.createDataFrame(list(enumerate(lengths)), "piece long, length long")  # names of results
    plans = set()
    for parts in (1, 7, 211):
        packed = best_fit(rows.repartition(parts), "piece", "length")
        found = packed.toDF("id", *packed.columns[1:]).groupBy("bin_id", "capacity").agg(F.sum("length").alias("used"), F.count("*").alias("n")).collect()
        assert all(r["used"] <= r["capacity"] for r in found) and {r["bin_id"] for r in found} == set(range(len(found)))
        assert sum(r["used"] for r in found) / sum(r["capacity"] for r in found) > 0.99
        plans.add(tuple(sorted((r["bin_id"], r["used"], r["n"]) for r in found)))
    assert len(plans) == 1


def test_packing_plan_is_bounded_by_the_lengths():
    rng = np.random.default_rng(5)
    sizes, steps = np.arange(1, 4097), []
    for most in (100, 10**9):
        plan = plan_bins(sizes, rng.integers(1, most, 4096))
        steps.append(len(plan.size))
        assert (np.diff(plan.range_first) > 0).all()
    assert max(steps) < 12 * 3 * 4096


def test_packing_counts_tokens(spark, tmp_path):
    import public_tokenizers

    import corpus_pipeline

    rows = [(1, prose(900)), (2, "語" * 9000), (3, "x1" * 20_000), (4, "a b"), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    truth = {r["doc_id"]: r["n_tokens"] for r in token_counts(docs, str(public_tokenizers.path("byte_bpe_50k.json"))).collect()}
    assert truth[2] > 4096 and truth[3] > 4096 and truth[1] > 900
    for packed in (QUERIES["op10_best_fit"](spark, str(tmp_path)), corpus_pipeline.packing(spark, docs, str(tmp_path))):
        pieces = {}
        for r in packed.collect():
            pieces.setdefault(r["doc_id"], []).append(r)
            assert r["bin_id"] is None or r["offset"] + r["length"] <= r["capacity"]
        assert {i: sum(r["length"] for r in own) for i, own in pieces.items()} == truth
        assert all([r["start"] for r in sorted(own, key=lambda r: r["piece"])] == list(range(0, max(1, truth[i]), 4096)) for i, own in pieces.items())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    result = con.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    expected = sorted(map(repr, result.fetchall()))
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == expected


def test_quality_sample_bounds_what_reaches_the_driver(spark):
    from pyspark.sql import functions as F

    from cellflux.llm.quality import drawn

    rows = spark.range(0, 20_000, 1, 40)
    every = [r["id"] for r in rows.orderBy(F.xxhash64(F.lit(3), F.col("id")), "id").limit(1_000).collect()]
    found = drawn(rows, 1_000)
    assert [r["id"] for r in found.collect()] == every
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" in plan and "Filter" in plan
    assert drawn(rows, 30_000).count() == 20_000 and drawn(rows.where("id < 0"), 10).count() == 0
