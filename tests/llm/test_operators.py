"""Each operator against brute force on the smallest table and on edge cases: nulls, empties, ties, repeats, clashing columns."""

import base64
import hashlib
import itertools
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
import tokenizers
from pyspark.sql import functions as F

from cohortscore.llm import attention_lm, bpe, exact_dedup, html_extract, jaccard_join, lm_scoring, packing, quality, secret_scan, shingle_words, substring_dedup, url_filter
from cohortscore.llm.oracle import ORACLE
from cohortscore.llm.queries import QUERIES
from compare import canon

SF = "/root/testdata/sf0.001"
RANKS = P.path("byte_bpe_50k.tiktoken")
GAP = "[\x20\x09-\x0d]+"
LOREM = " ".join(f"w{i}" for i in range(120))


def words(text):
    return [w for w in re.split(GAP, text or "") if w]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and columns named like the results."""
    rows = [(1, LOREM, "en", None, "x"), (2, LOREM, "en", "s", "x"), (2, LOREM, "en", "s", "x"), (3, None, None, None, None), (4, "", "en", "s", "y"), (5, LOREM + " tail", "en", "s", "z"), (6, "a b", "en", "s", "z"), (7, LOREM.upper(), "en", "s", "z"), (8, "x y z " * 20_000, "de", "s", "z"), (9, LOREM.replace("w60 ", "q "), "de", "s", "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, keep_id string").repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert canon(QUERIES[name](spark, SF).toPandas()) == canon(db.execute(ORACLE[name]).df())


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert quality.quality_rules(none).count() == 0
    assert exact_dedup.exact_dedup(none).count() == 0
    assert jaccard_join.jaccard_join(none, 85, 4).count() == 0
    assert substring_dedup.substring_dedup(none).count() == 0
    assert packing.pack_documents(none, RANKS, P.PATTERN).count() == 0
    assert secret_scan.secret_scan(none).count() == 0
    assert bpe.token_digests(none, RANKS, P.PATTERN).count() == 0
    assert lm_scoring.lm_scores(none, RANKS, P.PATTERN).count() == 0
    assert html_extract.extract(docs.selectExpr("doc_id page_id", "text url", "text html").limit(0)).count() == 0


def test_scores_of_edges(spark, edge):
    """Nulls, repeats, a very long text and clashing names; and a table whose rows are all held out."""
    got = Counter((r["id"], r["n_tokens"]) for r in lm_scoring.lm_scores(edge.withColumnRenamed("keep_id", "score"), RANKS, P.PATTERN, sample=5).collect())
    assert got[3, 1] == got[4, 1] == 1 and got[2, 121] == 2 and got[8, 60_001] == 1
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    out = lm_scoring.lm_scores(spark.createDataFrame([(i, "a b c") for i in held], "doc_id long, text string"), RANKS, P.PATTERN).collect()
    assert len(out) == len(held) and all(r["held_out"] and r["train_tokens"] == 0 and r["n_known"] == 0 and np.isfinite(r["score"]) for r in out)


def brute_mcd(groups):
    """Centre and covariance of each group of vectors: single rows, distances sorted, matrices inverted."""
    noise = np.diag([float(f[2] ** 2) for f in quality.FEATURES])
    apart = lambda x, m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)

    def fitted(x, pool, scale):
        both, w = np.concatenate([x, pool]), np.concatenate([np.ones(len(x)), np.full(len(pool), quality.PRIOR / len(pool))])
        m = w @ both / w.sum()
        return m, scale * ((both - m).T * w) @ (both - m) / w.sum() + noise

    def near(x, fit):
        return x[np.argsort(apart(x, *fit), kind="stable")[: int(np.ceil(quality.SUBSET * len(x)))]]

    first = {}
    for g, x in groups.items():
        m = np.median(x, 0)
        d = np.sqrt((1.4826 * np.median(abs(x - m), 0)) ** 2 + np.diag(noise))
        z = (x - m) / d
        shapes = [np.eye(4)]
        for y in (np.tanh(z), z / np.maximum(np.linalg.norm(z, axis=1), 1e-9)[:, None]):
            c = np.cov(np.round(1000 * y).T, bias=True) + 1e4 * np.eye(4)
            shapes.append(c / np.sqrt(np.outer(np.diag(c), np.diag(c))))
        first[g] = [(m, c * np.outer(d, d)) for c in shapes]
    pool = np.concatenate([near(x, first[g][0]) for g, x in groups.items()])
    best = {}
    for g, x in groups.items():
        fits = first[g]
        for _ in range(quality.STEPS):
            fits = [fitted(near(x, f), pool, quality.SUBSET_SCALE) for f in fits]
        best[g] = min(fits, key=lambda f: np.linalg.slogdet(f[1])[1])
    inside = {g: x[apart(x, *best[g]) <= quality.NEAR] for g, x in groups.items()}
    pool = np.concatenate(list(inside.values()))
    out = {g: fitted(x, pool, quality.NEAR_SCALE) for g, x in inside.items()}
    return {g: (*f, apart(groups[g], *f) > quality.CUT) for g, f in out.items()}


def test_minimum_covariance_determinant(spark):
    """Large groups of their own shape, a small one, one of equal rows; a fifth of `b` is one far cluster, which would
    carry off a mean and covariance of all rows: all of it is found, and no row of the rest."""
    rng = np.random.default_rng(5)
    mix = rng.normal(size=(4, 4)) * 120
    groups = {"a": rng.normal(size=(600, 4)) @ mix + [1600, 300, 200, 100], "b": rng.normal(size=(500, 4)) * 60 + [2500, 0, 0, 400], "c": rng.normal(size=(12, 4)) * 50 + [1700, 200, 100, 100], "d": np.full((30, 4), 900.0)}
    groups["b"][:100] = rng.normal(size=(100, 4)) * 30 + [3600, 1500, 0, 400]
    groups = {g: np.round(x) for g, x in groups.items()}
    rows = [(g, *map(int, v)) for g, x in groups.items() for v in x]
    df = spark.createDataFrame(rows, "g string, x0 long, x1 long, x2 long, x3 long").repartition(4)
    fits = quality.estimates(df, ["g"])
    got, want = {r["g"]: r for r in fits.collect()}, brute_mcd(groups)
    far = {(r["g"], *(r[f"x{i}"] for i in range(4))) for r in quality.with_distance(df, fits, ["g"]).filter(f"d2 > {quality.CUT}").collect()}
    for g, (m, c, out) in want.items():
        low = np.array([[got[g][f"l{i}{j}"] if j <= i else 0.0 for j in range(4)] for i in range(4)])
        assert np.allclose([got[g][f"m{i}"] for i in range(4)], m, atol=10) and np.allclose(low @ low.T, c, rtol=0.05, atol=800)
        assert {tuple(map(int, v)) for v in groups[g][out]} == {k[1:] for k in far if k[0] == g}
    assert want["b"][2].tolist() == [True] * 100 + [False] * 400 and quality.estimates(df.limit(0), ["g"]).count() == 0


def test_quality_edges(edge):
    got = {r["id"]: r for r in quality.quality_rules(edge).collect()}
    assert got[3]["n_words"] == got[4]["n_words"] == 0 and not got[3]["kept"]
    assert got[8]["base_failed"] and got[8]["n_repeat_words"] == 60_000
    assert got[1]["n_words"] == 120 and got[1]["kept"]


def test_exact_edges(edge):
    got = {r["id"]: r for r in exact_dedup.exact_dedup(edge).collect()}
    assert (got[1]["keep_id"], got[1]["group_size"], got[1]["kept"]) == (2, 3, False)
    assert got[2]["kept"] and got[3]["keep_id"] == 4 and got[9]["group_size"] == 1
    assert exact_dedup.drop_exact_copies(edge).columns == edge.columns


@pytest.mark.parametrize("small", [48, 2])
def test_jaccard(spark, edge, docs, monkeypatch, small):
    """With `small` 2 nearly every cell is divided by pivots, again and again."""
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    rng = np.random.default_rng(1)
    base = [f"v{i}" for i in range(60)]
    changed_words = [(100 + i, " ".join(f"q{i}" if j in set(rng.integers(0, 60, i % 4)) else w for j, w in enumerate(base[: 60 - i % 5]))) for i in range(60)]
    close = spark.createDataFrame(changed_words, "doc_id long, text string")
    for df in (edge, docs, close):
        sets = {}
        for i, t in rows_of(df):
            w = words(lower(t))
            sets[i] = {tuple(w[j : j + 4]) for j in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set()
        root = {i: i for i in sets}
        changed = True
        while changed:
            changed = False
            for a in sets:
                for b in sets:
                    if root[b] < root[a] and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                        root[a], changed = root[b], True
        got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_join(df, 85, 4).collect()}
        assert got == {i: (len(s), root[i]) for i, s in sets.items()}


def test_hashed_texts_are_the_words(docs):
    texts = [r["text"] for r in docs.select("text").collect()] + [None, "", " \n", "a", "\u00a0x é\x0b", "A b  a B"]
    column = pa.array(["skip", *texts]).slice(1)
    for low in (False, True):
        h, bounds = shingle_words.hashed_texts(column, low)
        lists = shingle_words.word_lists(texts, low)
        assert np.diff(bounds).tolist() == [len(w) for w in lists]
        of = {}
        assert all(of.setdefault(w, x) == x for w, x in zip((w for ws in lists for w in ws), h.tolist())) and len(set(of.values())) == len(of)


def test_substrings(edge, docs):
    for df in (edge, docs):
        first, want = {}, {}
        for i, t in sorted(rows_of(df)):
            w = words(t)
            gone = set()
            for j in range(len(w) - 49):
                if first.setdefault(tuple(w[j : j + 50]), i) < i:
                    gone.update(range(j, j + 50))
            kept = [x for k, x in enumerate(w) if k not in gone]
            want[i] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
        assert {r["id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.substring_dedup(df).collect()} == want


def test_a_text_that_repeats_itself_is_sent_once(spark):
    """Two texts of 1.2 MB, each one period of three words throughout, and a third with another end."""
    long = "x y z " * 200_000
    rows = spark.createDataFrame([(1, long), (2, long), (3, long[:600_000] + " end")], "doc_id long, text string")
    pairs = rows.selectExpr("doc_id id", "text", "xxhash64(doc_id, text) uid")
    found = substring_dedup.seeds(pairs, 50).groupBy("seed").count().collect()
    assert all(r["count"] <= 3 for r in found)
    got = {r["id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup.substring_dedup(rows).collect()}
    assert got == {1: (600_000, 0), 2: (600_000, 600_000), 3: (300_001, 300_000)}


def test_bpe_round_trip(spark, edge, docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    long = spark.createDataFrame([(50, "é nn " * 30_000 + "a" * 3_000 + " 12 " * 9_000)], "doc_id long, text string")
    df = edge.select("doc_id", "text").union(docs.select("doc_id", "text")).union(long)
    want = Counter()
    for i, t in rows_of(df):
        ids = enc.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in bpe.token_digests(df, RANKS, P.PATTERN).collect()) == want


def test_packing(edge):
    got = packing.pack_documents(edge, RANKS, P.PATTERN, 256).collect()
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert {(r["length"], r["crc"]) for r in got if r["id"] in (3, 4)} == {(1, zlib.crc32(b"\0\0\0\0"))}


def test_piece_ids_are_those_of_tokenizers(spark, docs):
    json = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    literal = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "  <|endoftext|>\n y<|endoftext|>", "<|endoftext |>", "w " * 300 + "<|endoftext|>"]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(literal, 10**9)), "doc_id long, text string"))
    got = {}
    for r in sorted(packing.token_pieces(df, RANKS, P.PATTERN, 256, ids=True).collect(), key=lambda r: (r["id"], r["piece"])):
        assert r["start"] == len(got.setdefault(r["id"], [])) and zlib.crc32(r["ids"]) == r["crc"]
        got[r["id"]] += np.frombuffer(r["ids"], "<u4").tolist()
    assert got == {i: [*json.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows_of(df)}


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(0)
    counts = {int(k): int(v) for k, v in zip(*np.unique(rng.integers(1, 65, 5000), return_counts=True))}
    used, sequences = Counter(), 0
    for pattern, n in packing.plan(counts, 64):
        assert sum(x * k for x, k in pattern) <= 64
        sequences += n
        for x, k in pattern:
            used[x] += k * n
    assert used == counts and sequences <= 1.01 * sum(x * k for x, k in counts.items()) / 64 + 1


def test_scores(docs):
    got = {r["id"]: r for r in lm_scoring.lm_scores(docs, RANKS, P.PATTERN, sample=60).collect()}
    tokens = {i: [*words(lower(t)), None] for i, t in rows_of(docs)}
    counts = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n = sum(counts.values())
    for i, ws in tokens.items():
        base = sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (len(counts) + 1))) for w in ws)
        assert got[i]["n_tokens"] == len(ws) and got[i]["train_tokens"] == n and got[i]["n_known"] == sum(counts[w] > 0 for w in ws)
        assert got[i]["base_score"] == pytest.approx(base, rel=1e-9) and -np.inf < got[i]["score"] < 0


def test_all_training_texts_teach(docs):
    taught = docs.filter("crc32(string(doc_id)) % 10 != 0").selectExpr("doc_id id", "text")
    counts = lm_scoring.subword_counts(taught, RANKS, P.PATTERN)
    enc = bpe.Codec.of(RANKS, P.PATTERN).encoding
    lists = [words(lower(r["text"])) for r in taught.collect()]
    assert counts == Counter(i for ws in lists for w in ws for i in enc.encode_ordinary(" " + w))
    subwords = lm_scoring.Subwords(RANKS, P.PATTERN, counts)
    model, learnt = lm_scoring.fit(taught, subwords, counts, 0)  # no sample to start from
    assert learnt == sum(counts.values()) + len(lists)
    held = lm_scoring.Sequences(subwords).of([r["text"] for r in docs.filter("crc32(string(doc_id)) % 10 = 0").collect()])
    symbols = np.bincount(subwords.symbol[list(counts)], list(counts.values()), subwords.size)
    untaught = attention_lm.start(subwords.size, symbols)
    assert attention_lm.score(model, held)[0].sum() > attention_lm.score(untaught, held)[0].sum()


def test_attention_is_causal_and_normalised():
    model = attention_lm.Attention.new(64)
    text = np.random.default_rng(0).integers(1, 64, 40).astype(np.int32)
    other = text.copy()
    other[30:] = 5
    assert np.allclose(attention_lm.score(model, [text])[0][:30], attention_lm.score(model, [other])[0][:30], atol=1e-5)
    each = [attention_lm.score(model, [np.append(text[:20], s).astype(np.int32)])[0][-1] for s in range(64)]
    assert np.exp(each).sum() == pytest.approx(1, abs=1e-4)


def slow_symbol(model, seq, t):
    """Probabilities of all symbols at place t of a text, one query at a time."""
    p, c = {k: v.astype(float) for k, v in model.p.items()}, attention_lm.CONTEXT
    begin = t // attention_lm.SCORED * attention_lm.SCORED
    seen = [seq[i - 1] if i > 0 else 0 for i in range(begin - c, t + 1)]
    h = p["E"][seen] + p["P"][: len(seen)]
    w = np.exp(h @ p["K"] @ (h[-1] @ p["Q"]) / attention_lm.WIDTH**0.5)
    o = h[-1] + w @ (h @ p["V"]) / w.sum() @ p["O"]
    z = o + np.maximum(o @ p["A"], 0) @ p["B"]
    soft = lambda x: np.exp(x) / np.exp(x).sum()
    return np.concatenate([g * soft(z @ p["W"][i] + p["b"][i]) for i, g in enumerate(soft(z @ p["U"] + p["c"]))])


def test_score_by_a_slow_scorer(docs):
    """The query's `score` from the same weights, symbol by symbol; and the shares of words and end sum to 1 at most."""
    taught = docs.filter("crc32(string(doc_id)) % 10 != 0").selectExpr("doc_id id", "text")
    counts = lm_scoring.subword_counts(taught, RANKS, P.PATTERN)
    subwords = lm_scoring.Subwords(RANKS, P.PATTERN, counts)
    model, _ = lm_scoring.fit(taught, subwords, counts, 60)
    total = Counter(w for _, t in rows_of(docs.join(taught.selectExpr("id doc_id"), "doc_id")) for w in [*words(lower(t)), None])
    n, opening = sum(total.values()), subwords.groups * attention_lm.MEMBERS
    got = {r["id"]: r["score"] for r in lm_scoring.lm_scores(docs, RANKS, P.PATTERN, sample=60).collect()}
    for i, text in sorted(rows_of(docs), key=lambda r: (len(r[1] or ""), r[0]))[::40]:
        ws = words(lower(text))
        ids = subwords.of([w.encode() for w in ws])
        seq = [s for x in ids for s in subwords.symbol[x]] + [0]
        at, want, opened = 0, 0.0, None
        for w, x in zip([*ws, None], [*ids, None]):
            here = slow_symbol(model, seq, at)
            log = -np.log(here[:opening].sum())
            for k in x if x else []:
                log += np.log(slow_symbol(model, seq, at)[subwords.symbol[k]]) + subwords.within[k]
                at += 1
            log += np.log(slow_symbol(model, seq, at)[:opening].sum()) if x else np.log(here[0])
            want += np.log10(lm_scoring.SHARE * np.exp(log) + (1 - lm_scoring.SHARE) * total[w] / n)
        assert got[i] == pytest.approx(want, rel=1e-4)
    known = [w for w in total if w]
    ids = subwords.of([w.encode() for w in known])
    seqs = [np.append(subwords.symbol[x], 0).astype(np.int32) for x in ids]
    logs, opened = attention_lm.score(model, seqs, subwords.groups)
    share, at = 0.0, 0
    for x, seq in zip(ids, seqs):
        part = slice(at, at := at + len(seq))
        share += np.exp(lm_scoring.token_logs(logs[part], opened[part], np.array([len(x)]))[0] + subwords.within[x].sum())
    end = np.exp(lm_scoring.token_logs(*attention_lm.score(model, [np.zeros(1, np.int32)], subwords.groups), np.array([], int))[0])
    assert 0.3 < share + end < 1 + 1e-4


def test_html():
    model = html_extract.Model.fit(html_extract.labelled_pages())
    page = "<html><body><nav><ul><li><a href=/>menu words</a></li></ul></nav><script>var t='</p>';</script><article><h1>Title &amp; more</h1><p>One  <b>two</b>three.<br>four<p>Five</article><div class=comments><p>nice post by a reader, who says more and more</p></div><footer>foot</footer>"
    assert model.text(page) == "Title & more One twothree. four Five" and model.text("") == ""
    right = total = 0
    for made, labels in html_extract.labelled_pages(100, 7):
        for p, y in zip(model.marginals(html_extract.parse(made)[0]), labels):
            right, total = right + ((p >= 0.5) == y), total + 1
    assert right / total > 0.97


def test_html_of_odd_pages(spark):
    model = html_extract.Model.fit(html_extract.labelled_pages())
    page = lambda inner: f"<html><body><nav><ul><li><a href=/>menu</a></li></ul></nav><article><h1>A title of words</h1><p>A first paragraph with many words in it, so that it is text.</p>{inner}</article></body></html>"
    start = "A title of words A first paragraph with many words in it, so that it is text."
    assert model.text(page("<p title='it's'>Hello there, this is the second paragraph of the page</p>")) == start + " Hello there, this is the second paragraph of the page"
    assert model.text(page("<p>Some words here <span class='advert'>Buy <span>it</span> now</span> and the words go on to the end</p>")) == start + " Some words here and the words go on to the end"
    assert model.text(page("<p>The formula <math><mi>x</mi><mo>=</mo><mn>2</mn></math> stands in the text as it is</p>")) == start + " The formula x=2 stands in the text as it is"
    assert model.text(page("<p>Before it <iframe src=x> and after what is never closed, more words</p>")) == start + " Before it and after what is never closed, more words"
    rows = spark.createDataFrame([(1, "u", None, "x"), (2, "u", "", "x"), (3, "u", page(""), "x"), (3, "u", page(""), "x"), (4, "u", page("<p>" + "long text of words " * 20_000 + "</p>"), "x")], "page_id long, url string, html string, text string")
    got = sorted((r["id"], r["n_chars"]) for r in html_extract.extract(rows).collect())
    assert got == [(1, 0), (2, 0), (3, len(start)), (3, len(start)), (4, len(start) + 1 + 20_000 * 19 - 1)]


def test_marginals_equal_enumeration():
    """Sum-product against the sum over all labellings of small trees."""
    model = html_extract.Model.fit(html_extract.labelled_pages(60))
    for page in ("<div class=ad><p>one two</p></div><article><p>three four five six</p><ul><li>a<li>b</ul></article>", "<p>x", "<nav><a href=/>go</a></nav><main><h2>t</h2><section><p>words and more words</p></section></main>"):
        nodes, _ = html_extract.parse(page)
        seen = html_extract.observations(nodes)
        own = np.array([np.sum([model.seen.get(s, (0.0, 0.0)) for s in o], axis=0) for o in seen])
        total, content = 0.0, np.zeros(len(nodes))
        for labels in itertools.product((0, 1), repeat=len(nodes)):
            log = model.root[labels[0]] + sum(own[i][y] for i, y in enumerate(labels))
            log += sum(model.edge[int(n.tag in html_extract.CONTAINERS)][labels[n.parent]][labels[i]] for i, n in enumerate(nodes) if n.parent >= 0)
            total += np.exp(log)
            content += np.exp(log) * np.array(labels)
        assert np.allclose(model.marginals(nodes), content / total, atol=1e-9)


def test_secrets(spark):
    forest, transitions = secret_scan.trained()
    held = secret_scan.labelled_findings(500, 9)
    p = forest.probability(np.array([secret_scan.features(t, a, b, transitions) for t, a, b, _ in held]))
    assert ((p >= 0.5) == np.array([r[3] for r in held])).mean() > 0.97
    rows = spark.createDataFrame([(1, 'x token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" y', 1), (2, "commit 04dbebab91ab85687d33eeaaf9ac699e1188f962 merged", 2), (3, None, 3)], "doc_id long, text string, length long")
    got = {r["doc_id"]: r["text"] for r in secret_scan.redacted(rows).collect()}
    assert got == {1: 'x token = "[SECRET]" y', 2: "commit 04dbebab91ab85687d33eeaaf9ac699e1188f962 merged", 3: None}


def test_secrets_of_every_form_from_raw_text(spark):
    forest, transitions = secret_scan.trained()
    taught = {t[a:b] for t, a, b, _ in secret_scan.labelled_findings()}
    held = [r for r in secret_scan.labelled_findings(800, 5) if r[0][r[1] : r[2]] not in taught]
    recall, touched = secret_scan.from_raw_text(held, forest, transitions)
    assert recall > 0.97 and touched < 0.03
    body = "\n".join(["q" * 32 + "A1+/" * 8] * 3)
    forms = ['password = "Tr0ub4dor&3xyz!"', 'token = "QWERTYUIOPASDFGHJKLZ"', "postgres://bob:s3cr3tPw!@db.example.com/x", r"passwd: 'a\'b99x'"]
    secret = ["Tr0ub4dor&3xyz!", "QWERTYUIOPASDFGHJKLZ", "s3cr3tPw!", r"a\'b99x"]
    for kind, head in (("RSA PRIVATE KEY", "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B\n\n"), ("PGP PRIVATE KEY BLOCK", "Version: GnuPG v2\n\n")):
        secret.append(f"-----BEGIN {kind}-----\n{head}{body}\n-----END {kind}-----")
        forms.append(f"see {secret[-1]} and on")
    df = spark.createDataFrame(list(enumerate(forms)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in secret_scan.redacted(df).collect()}
    for i, (form, s) in enumerate(zip(forms, secret)):
        assert form.index(s) in {a for a, b in secret_scan.spans(form) if form[a:b] == s}
        assert s not in got[i] and "[SECRET]" in got[i]
    assert got[4] == got[5] == "see [SECRET] and on"


def test_secret_features_cover_long_candidates():
    text = "a1" * 5_000 + "/B+" * 3_000 + ".html"
    got = dict(zip(secret_scan.NAMES, secret_scan.features(text, 0, len(text), secret_scan.letter_transitions())))
    n = len(text)
    assert got["length"] == n and got["path_parts"] == 3_000 and got["extension"] == 1
    assert got["digits"] == 5_000 / n and got["upper"] == 3_000 / n and got["distinct"] == len(set(text)) / n


def test_urls(spark):
    pages = spark.createDataFrame([(1, "http://WWW.A.example.org/es/1"), (2, "https://b.example.com/x/?ref=1#t"), (3, None), (4, "nothing"), (5, "http://c.com")], "page_id long, url string")
    listed = spark.createDataFrame([("http://m.b.example.com/x",), (None,)], "url string")
    got = {r["id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.url_filter(pages, listed, (("allow", "org", "/"), ("block", "example.org", "/es/"))).collect()}
    assert got == {1: ("www.a.example.org", "/es/1", "example.org/es/", "block"), 2: ("b.example.com", "/x/", None, "block"), 3: ("", "", None, "allow"), 4: ("", "", None, "allow"), 5: ("c.com", "", None, "allow")}


def test_url_edges(spark):
    """Empty tables, repeated rows on both sides, a very long URL, and columns named like the results."""
    rows = [(1, "http://a.net/x", "r"), (1, "http://a.net/x", "r"), (2, "http://b.net/" + "y" * 200_000, None), (3, "", "r"), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string").withColumn("verdict", F.lit("v")).withColumn("block", F.lit(1))
    listed = spark.createDataFrame([("http://a.net/x",), ("http://a.net/x",), ("http://b.net/" + "y" * 200_000,)], "url string")
    got = Counter((r["id"], r["verdict"]) for r in url_filter.url_filter(pages, listed, ()).collect())
    assert got == {(1, "block"): 2, (2, "block"): 1, (3, "allow"): 1, (None, "allow"): 1}
    assert {r["verdict"] for r in url_filter.url_filter(pages, listed.limit(0), ()).collect()} == {"allow"}
    assert url_filter.url_filter(pages.limit(0), listed, ()).count() == 0


def test_secret_edges(spark):
    """Null, empty, very long and repeated texts, two equal secrets in one text, and columns named like the results."""
    key = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'
    texts = [(1, key), (1, key), (2, None), (3, ""), (4, "plain words " * 50_000 + key), (5, key + " and " + key)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("length", F.lit(1)).withColumn("start", F.lit("s"))
    out = secret_scan.redacted(docs)
    clean = key.replace("04dbebab91ab85687d33eeaaf9ac699e1188f962", "[SECRET]")
    want = [(1, clean), (1, clean), (2, None), (3, ""), (4, "plain words " * 50_000 + clean), (5, clean + " and " + clean)]
    assert out.columns == docs.columns and sorted((r["doc_id"], r["text"] or "") for r in out.collect()) == sorted((i, t or "") for i, t in want)
    assert secret_scan.redacted(docs.limit(0)).count() == 0


def brute_good(rows):
    """Ids that the quality rules keep, of (id, text, lang, source)."""
    groups, ids = {}, {}
    for i, text, lang, source in rows:
        w, t = words(text), text or ""
        lines = [x for x in t.split("\n") if words(x)]
        places = {}
        for j in range(len(w) - 2):
            places.setdefault(tuple(w[j : j + 3]), []).append(j)
        again = {j + k for js in places.values() if len(js) > 1 for j in js for k in range(3)}
        if len(w) < 50 or 100 * len(again) > 50 * len(w):
            continue
        rates = [np.log(sum(map(len, w)) / len(w)), (sum(c in "#*$%&|<>" for c in t) / len(w)) ** 0.5, ((len(lines) - len(set(lines))) / len(lines)) ** 0.5, (len(again) / len(w)) ** 0.5]
        groups.setdefault((lang or "", source or ""), []).append(np.floor(1000 * np.array(rates) + 0.5))
        ids.setdefault((lang or "", source or ""), []).append(i)
    far = brute_mcd({g: np.array(x) for g, x in groups.items()})
    return {i for g, members in ids.items() for i, out in zip(members, far[g][2]) if not out}


def test_pipeline(spark, docs):
    """Stage by stage against brute force, each on what the stage before it left; and the run as the stages one after the other."""
    import corpus_pipeline

    stages = [stage for _, stage in corpus_pipeline.STAGES]
    rows = lambda df: {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
    good = stages[0](spark, docs, SF).cache()
    assert set(rows(good)) == brute_good([tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]) and len(rows(good)) < docs.count()
    single, last = stages[1](spark, good, SF).cache(), {}
    for i, t in rows(good).items():
        last[t] = max(i, last.get(t, i))
    assert rows(single) == {i: t for t, i in last.items()}
    apart = stages[2](spark, single, SF).cache()
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, t in rows(single).items() for w in [words(lower(t))]}
    root = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = {i: low if r == high else r for i, r in root.items()}
    assert set(rows(apart)) == {i for i, r in root.items() if i == r}
    clean = stages[3](spark, apart, SF).cache()
    assert rows(clean).keys() == rows(apart).keys() and all(r["n_chars"] == len(r["text"]) for r in clean.collect())
    assert all(df.columns == docs.columns for df in (good, single, apart, clean))
    tok = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    places, got = {}, {}
    for r in stages[4](spark, clean, SF).collect():
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        got.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for spans in places.values():
        ends = np.cumsum([n for _, n in sorted(spans)])
        assert [o for o, _ in sorted(spans)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert got.keys() == rows(clean).keys()
    for i, t in rows(clean).items():
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4")
        pieces = sorted(got[i])
        assert [p[1] for p in pieces] == [0, *np.cumsum([p[2] for p in pieces])[:-1]] and sum(p[2] for p in pieces) == len(ids)
        assert all(crc == zlib.crc32(ids[at : at + n].tobytes()) for _, at, n, crc in pieces)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == got.keys()


def test_pipeline_edges(spark, edge):
    """Nulls in any column, empty and very long texts, ties and repeated rows go through every stage, and so does an empty table."""
    import corpus_pipeline

    docs = edge.selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as long) n_chars", "keep_id")
    kept = none = docs
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept, none = stage(spark, kept, SF), stage(spark, none, SF)
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF).collect()
    # 3, 4, 6 and 8 fail the base rules; 1, 2 and 7 differ by case at most and 5, 9 by a word.
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in kept.collect()} <= {1, 2, 5, 7, 9} and packed
    assert none.count() == 0 and corpus_pipeline.STAGES[-1][1](spark, none, SF).count() == 0
