"""Fill-in-middle, periodic runs and line dedup against brute force and on edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest

from cohortscore.llm import fill_middle, line_dedup, periodic_runs
from cohortscore.llm.queries import planted_runs

GAP = "[\x20\x09-\x0d]+"


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and very long texts, ties, repeated rows, a sentinel, letters of many bytes, columns named like the results."""
    texts = [None, "", " \n\t", "one two", "ab<S>cd", "été \U0001f600 Cafés\r\nstraße", "x y z " * 60_000, "go " * 50_000, "\n" * 3, "a" * 300_000]
    rows = [(i, t, "n", "out", "runs") for i, t in enumerate(texts)] + [(3, "one two", None, "z", "z"), (3, "one two", "n", "out", "runs"), (None, "no id here", "n", None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n string, output string, runs string").repartition(3)


def cut(doc_id, text):
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    parts = ["".join(x) for x in (units[:a], units[a:b], units[b:])]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    p, m, s = parts
    form = "spm" if h[3] % 100 < 20 else "psm"
    return len(units), form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def test_fill_in_middle_edges(spark, edge):
    got = fill_middle.restored(fill_middle.fill_in_middle(edge)).collect()
    assert len(got) == edge.count()
    want = sorted((cut(r["doc_id"], r["text"] or "") + (r["text"] or "",) for r in edge.collect()), key=str)
    assert sorted(((r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["restored"]) for r in got), key=str) == want
    assert {"psm", "spm", "plain"} >= {r["form"] for r in got}
    assert fill_middle.restored(fill_middle.fill_in_middle(edge.limit(0))).count() == 0
    assert fill_middle.restored(spark.createDataFrame([(None, "x"), ("psm", None)], "form string, output string")).filter("restored IS NULL").count() == 2


def test_rotations_of_any_size():
    rng = random.Random(3)
    for block in (1, 2, 5, 1 << 16):
        fill_middle.BLOCK, before = block, fill_middle.BLOCK
        for _ in range(300):
            raw = bytes(rng.randrange(256) for _ in range(rng.randrange(0, 40)))
            a, m, b = sorted(rng.randrange(len(raw) + 1) for _ in range(3))
            buf = bytearray(raw)
            fill_middle.rotate(np.frombuffer(buf, np.uint8), a, m, b)
            assert bytes(buf) == raw[:a] + raw[m:b] + raw[a:m] + raw[b:]
            text = bytearray(rng.choice((b"<", b"P>", b"<S", b"M", b">")) * rng.randrange(3) + bytes(rng.choices(b"<PSM>ab", k=12)))
            if any(s in text for s in (b"<P>", b"<S>", b"<M>")):
                continue
            one, two = sorted(rng.randrange(len(text) + 1) for _ in range(2))
            for form in ("psm", "spm"):
                buf = bytearray(text)
                fill_middle.transform(buf, one, two, form)
                p, m, s = bytes(text[:one]), bytes(text[one:two]), bytes(text[two:])
                assert bytes(buf) == (b"<P>" + p + b"<S>" + s + b"<M>" + m if form == "psm" else b"<S>" + s + b"<P>" + p + b"<M>" + m)
                fill_middle.restore(buf, form)
                assert buf == text
        fill_middle.BLOCK = before


def brute_runs(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_of_random_texts(spark):
    """Small alphabets, blocks set into one another, exact squares of whole texts, many texts in one grammar."""
    rng = random.Random(11)
    rows = []
    for i in range(1500):
        k = rng.choice([1, 2, 2, 3, 5, 40])
        w = [f"w{rng.randrange(k)}" for _ in range(rng.randrange(60))]
        while rng.random() < 0.6:
            block = [f"w{rng.randrange(k)}" for _ in range(rng.randrange(1, 9))] * rng.randrange(3, 9)
            at = rng.randrange(len(w) + 1)
            w[at:at] = block[: rng.randrange(len(block) + 1)]
        rows.append((i, " ".join(w * rng.choice([1, 1, 1, 2]))))
    got = periodic_runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts, some = dict(rows), 0
    for r in got:
        words = texts[r["id"]].split()
        runs = brute_runs(words)
        some += bool(runs)
        assert [tuple(x) for x in r["runs"]] == runs and r["n_words"] == len(words) and r["collapsed"] == collapsed(words, runs)
    assert len(got) == 1500 and some > 500


def test_run_edges(spark, edge):
    got = periodic_runs.periodic_runs(edge).collect()
    assert len(got) == edge.count()
    by = {r["id"]: r for r in got if r["id"] is not None}
    assert by[0]["n_words"] == by[1]["n_words"] == by[2]["n_words"] == 0 and by[0]["collapsed"] == "" and by[0]["runs"] == []
    assert [tuple(x) for x in by[6]["runs"]] == [(0, 180_000, 3)] and by[6]["collapsed"] == "x y z"
    assert [tuple(x) for x in by[7]["runs"]] == [(0, 50_000, 1)] and by[7]["collapsed"] == "go"
    assert [r["collapsed"] for r in got if r["id"] == 3] == ["one two"] * 3
    assert periodic_runs.periodic_runs(edge.limit(0)).count() == 0


def test_planted_words(spark, edge):
    """What the query repeats: words from a place on, in every tenth document by crc32."""
    import zlib

    rows = [(i, " ".join(f"w{j}" for j in range(1 + i % 50))) for i in range(200)]
    for r in planted_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        words, h = dict(rows)[r["doc_id"]].split(), zlib.crc32(str(r["doc_id"]).encode())
        n, g = len(words), h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        assert re.split(GAP, r["text"]) == words
    assert planted_runs(edge).filter("text IS NULL").count() == 0


def brute_lines(rows, least=20, often=3):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\f\r"))

    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= least:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [i is None or len(holders.get(key(x), ())) < often or max(holders[key(x)]) == i for x in lines]
        out.append((i, len(lines), keep.count(False), "\n".join(x for x, k in zip(lines, keep) if k), keep))
    return out


def test_line_dedup(spark):
    """Random lines with blanks, cases, marks that are not ASCII blanks, repeated ids, null ids and texts; a line in all rows."""
    rng = random.Random(5)
    common = ["Shared line number %d of the corpus" % i for i in range(6)] + ["short", "", "x" * 19, "y" * 20, "É" * 20, "trailing mark of the line \u0085", "same words with a separator   inside"]
    rows = []
    for i in range(300):
        lines = [rng.choice(["", " ", "\t \r"]) + (x.upper() if rng.random() < 0.2 else x) + rng.choice(["", "  ", "\x0b"]) for x in rng.choices(common, k=rng.randrange(8))]
        rows.append((rng.choice([i, i, i, None, i // 7]), rng.choice(["\n", "\n", "\n\n"]).join([*lines, "The line that every row has, really"]) if rng.random() < 0.95 else None))
    rows += [rows[0], rows[0], (1000, ""), (1001, "\n\n"), (1002, "\n".join(["A very long text's only line, again"] * 40_000)), (1003, "A very long text's only line, again"), (1004, "a very long text's only line, AGAIN")]
    df = spark.createDataFrame([(i, t, "x", None) for i, t in rows], "doc_id long, text string, n_lines string, h1 long").repartition(5)
    got = line_dedup.line_dedup(df, text=True).collect()
    want = brute_lines(rows)
    assert sorted(((r["id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in got), key=str) == sorted((w[:4] for w in want), key=str)
    bitmaps = sorted(((r["id"], [i % 2 == 0 for i, k in enumerate(r["keep_runs"]) for _ in range(k)]) for r in got), key=str)
    assert bitmaps == sorted(((w[0], w[4]) for w in want), key=str)
    assert any(w[2] for w in want) and sum(w[2] for w in want) > 40_000
    assert line_dedup.line_dedup(df.limit(0), text=True).count() == 0


def test_long_white_space(spark):
    """Over a million of each kind of white space, alone and between words, as tokenizers encodes them; through op4 and op7."""
    import public_tokenizers as P
    import tokenizers

    from cohortscore.llm import bpe, packing

    whole = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ranks = P.path("byte_bpe_50k.tiktoken")
    codec = bpe.Codec.of(ranks, P.PATTERN)
    texts = [f"{before}{space * 1_100_000}{after}" for space in " \n\t\u00a0\u3000" for before, after in (("", ""), ("a", "b c"))]
    for text in [*texts, "a" + " " * 9_999 + "b", "\r" + "\n" * 10_000 + "  x"]:
        want = whole.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == want and packing.text_ids(codec, text).tolist() == want
    rows = [(i, texts[i]) for i in (0, 1, 3)] + [(1, texts[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = bpe.token_digests(df, ranks, P.PATTERN).collect()
    assert sorted((r["id"], r["decoded_sha256"]) for r in got) == sorted((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    packed = packing.pack_documents(df, ranks, P.PATTERN).groupBy("id").sum("length").collect()
    assert {r[0]: r[1] for r in packed} == {i: (2 if i == 1 else 1) * (len(whole.encode(t, add_special_tokens=False).ids) + 1) for i, t in rows}
