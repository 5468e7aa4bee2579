import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siteloom.llm import chosen_path, fingerprints, line_dedup, mixing, packing, pii, quality, range_coder, separator_scan, shingles, tokens, toxicity
from siteloom.llm.queries import BYTE_BPE, END_OF_TEXT, WORD_BPE

LINE = "this very line is long enough to be counted as repeated"
LONG = " ".join(f"w{i % 4001}" for i in range(20_000))
#: Nulls, empty and very long texts, repeated rows and ids, and columns that clash with the operators' own.
ROWS = [
    (1, "a b c d e f", "en", "s1", 11, "x", 1), (2, None, None, None, None, None, None), (3, "", "en", "s1", 0, "", 0), (4, LONG, "de", "s2", 9, "k", 2),
    (5, f"Hello there\n{LINE}", "en", "s1", 3, "k", 2), (6, f"{LINE.upper()} \nother", "en", None, 3, "k", 2), (7, f" {LINE}\nabc", "en", "s3", 3, "k", 2),
    (8, f"{LINE}\nabc 4111 1111 1111 1111 a.b@c.de", "en", "s3", 3, "k", 2), (9, f"{LINE}", "en", "s3", 3, "k", 2), (9, f"{LINE}", "en", "s3", 3, "k", 2),
    (None, "no id here at all", "en", "s1", 3, "k", 2), (10, LONG + " tail", "de", "s2", 9, "k", 2),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept_text string, size long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, COLUMNS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (4, 0), (5, None), (None, 1)], "doc_id long, toxic int")


DIGESTS = {
    "chosen_path": lambda d, l: chosen_path.digest(d), "packing": lambda d, l: packing.digest(d, BYTE_BPE), "quality": lambda d, l: quality.digest(d),
    "toxicity": lambda d, l: toxicity.digest(d, l), "mixing": lambda d, l: mixing.digest(d), "pii": lambda d, l: pii.digest(d), "line_dedup": lambda d, l: line_dedup.digest(d),
    "fingerprints": lambda d, l: fingerprints.digest(d), "range_coder": lambda d, l: range_coder.digest(d, WORD_BPE), "separator_scan": lambda d, l: separator_scan.digest(d, BYTE_BPE, END_OF_TEXT),
}


@pytest.mark.parametrize("name", DIGESTS)
def test_odd_rows_and_empty_tables(spark, docs, labels, name):
    got = DIGESTS[name](docs, labels).collect()
    assert {r.doc_id for r in got} == {r[0] for r in ROWS}
    if name != "packing":
        assert len(got) == len(ROWS)
    assert DIGESTS[name](spark.createDataFrame([], COLUMNS), labels).collect() == []


def test_stages_return_the_columns(docs, labels):
    for out in (toxicity.apply(docs, labels), line_dedup.apply(docs), chosen_path.apply(docs), mixing.apply(docs)):
        assert out.columns == docs.columns and out.count() > 0


def test_line_dedup_keeps_the_largest(docs):
    got = {r.doc_id: r for r in line_dedup.digest(docs).collect()}
    assert [got[i].n_dropped for i in (5, 6, 7, 8, 9)] == [1, 1, 1, 1, 0]
    assert got[5].kept_sha256 == hashlib.sha256(b"Hello there").hexdigest() and got[2].n_lines == 1


def test_near_copies_and_large_nodes(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(120):
        w = list(base)
        for k in rng.choice(60, rng.integers(0, 3), replace=False):
            w[k] = f"x{i}"
        texts.append(" ".join(w))
    rows = [(i, t) for i, t in enumerate([*texts, "lonely text of some words", "", None])]
    sets = [set(s.tolist()) for s in shingles.shingle_sets([shingles.words(t) for _, t in rows], 4)]
    low = list(range(len(rows)))
    for _ in range(len(rows)):
        for a in range(len(rows)):
            for b in range(a):
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                    low[a] = low[b] = min(low[a], low[b])
        if low == [low[c] for c in low]:
            break
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for parameters in ({}, {"leaf": 4, "levels": 2}):
        got = {r.doc_id: r for r in chosen_path.digest(df, **parameters).collect()}
        assert [got[i].component_id for i in range(len(rows))] == low
        assert [got[i].n_shingles for i in range(len(rows))] == [len(s) for s in sets]


def test_large_group_of_edited_copies_stays_whole(spark):
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(200)]
    rows = [(5000, " ".join(base))]
    for i in range(600):
        w = list(base)
        # Five edits apart from each other: 20 of 197 shingles go, two copies share less than the threshold asks.
        for k in (np.arange(5) * 40 + rng.integers(2, 30, 5)).tolist():
            w[k] = f"x{i}y{k}"
        rows.append((i, " ".join(w)))
    got = chosen_path.digest(spark.createDataFrame(rows, "doc_id long, text string"), leaf=64).collect()
    assert len(got) == len(rows) and {r.component_id for r in got} == {0}


@pytest.mark.parametrize("path", [BYTE_BPE, WORD_BPE])
def test_remembered_ids_equal_the_library(path):
    texts = ["", " a", "a ", "a  b", "\n a b", "a \n b", "x<|endoftext|> y", "a　 b", "'s 's a's", "é é b", "A\tB  C\r\n D", "Σας ΟΔΟΣ", "Hello, world!! It's 42% | fine.\nNext", LONG[:500]]
    t, m = Tokenizer.from_file(path), tokens.Memo(path)
    for _ in range(2):
        assert [np.frombuffer(x, m.dtype).tolist() for x in m.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_range_coder_round_trip_and_checksums(spark):
    rng = np.random.default_rng(1)
    zipf, flat, same = rng.zipf(1.3, 20_000) % 49_408, rng.integers(0, 49_408, 9_000), np.full(5_000, 7)
    cases = [(ids, width, vocabulary) for ids in (zipf[:0], zipf[:1], zipf[:2], zipf[:300], zipf, flat, same) for width, vocabulary in ((2, 49_408), (4, 200_000))]
    rows = [(i, bytearray(ids.astype(f"<u{width}").tobytes()), width, vocabulary) for i, (ids, width, vocabulary) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, ids binary, width int, vocabulary int")
    for block_ids in (1000, 1 << 16):
        got = df.select("i", range_coder.encoded(spark, F.col("ids"), F.col("width"), F.col("vocabulary"), block_ids).alias("p"))
        back = {r.i: np.frombuffer(r.b, "<u4") for r in got.select("i", range_coder.decoded(spark, F.col("p")).alias("b")).collect()}
        assert all((back[i] == ids).all() and len(back[i]) == len(ids) for i, (ids, _, _) in enumerate(cases))
    sizes = {r.i: len(r.p) for r in got.collect()}
    assert sizes[8] < 2 * 20_000 and sizes[12] < 400
    good = got.where("i = 8").first().p
    for at in (-40, len(good) // 2, 2):
        bad = bytearray(good)
        bad[at] ^= 255
        with pytest.raises(Exception, match="damaged|not a token-ID|incorrect"):
            spark.createDataFrame([(bad,)], "p binary").select(range_coder.decoded(spark, F.col("p"))).collect()


def test_packed_pieces_hold_each_id_once():
    lengths = [1, 5000, 2048, 1500, 1500, 700, 300, 20, 255, 1025, 4096] * 7
    windows = packing.pack(lengths)
    seen = [np.zeros(n, int) for n in lengths]
    for size, pieces in windows:
        held = sum(p[2] for p in pieces)
        assert held <= size <= 2048
        for doc, start, length in pieces:
            seen[doc][start : start + length] += 1
    assert all((s == 1).all() for s in seen)
    assert sum(sum(p[2] for p in ps) not in (256, 512, 1024, 2048) for _, ps in windows) <= 1


def test_tokens_by_brute_force(docs):
    word, byte = Tokenizer.from_file(WORD_BPE), Tokenizer.from_file(BYTE_BPE)
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, at = [], 0
    for r in order:
        ids = np.array([*word.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = sorted((r.start, r.n_tokens, r.ids_crc32) for r in range_coder.digest(docs, WORD_BPE).collect())
    assert got == sorted(want)
    count = sorted(r.n_tokens for r in separator_scan.digest(docs, BYTE_BPE, END_OF_TEXT).collect())
    assert count == sorted(len(byte.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in ROWS)


def test_separators_across_blocks(spark):
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 9, 5000).astype("<u2")
    raw = ids.tobytes()
    rows = [(0, b, 2, raw[i : i + 66], None) for b, i in enumerate(range(0, len(raw), 66))]
    blocks = spark.createDataFrame(rows, "file long, block long, width int, ids binary, doc_ids array<long>")
    ends = [*(np.flatnonzero(ids == 7) + 1).tolist(), len(ids)]
    want = [(a, b - a) for a, b in zip([0, *ends], ends) if b > a]
    assert sorted((r.start, r.n_tokens) for r in separator_scan.scan(blocks, 7).collect()) == want


def test_personal_data_and_discovery(spark):
    rows = [(i, f"contact me at user{i}@mail.example.com or later") for i in range(30)] + [(99, "contact me at user99(at)mail0.example.com soon"), (100, "x 999.1.1.1 1.2.3.4")]
    got = {r.doc_id: r for r in pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].spans == "email:14:37"[:9] + str(14 + len("user0@mail.example.com")) and got[0].n_email == 1
    assert (got[100].n_ip, got[100].spans.split(",")[0]) == (1, "ip:12:19")
    assert re.fullmatch("[0-9a-f]{64}", got[99].base_sha256) and got[99].n_email == 0


def test_context_of_seeds_finds_other_kinds_of_identifier(spark):
    rows = [(i, f"please reach us via user{i}@mail.example.com for any help today") for i in range(40)]
    # Another kind in the seeds' context; then, by the shape that those hold up, in a context of its own.
    new = [f"k{i:03d}-{i * 7 % 1000:03d}-zz" for i in range(30)]
    rows += [(100 + i, f"please reach us via {x} for any help today") for i, x in enumerate(new[:4])]
    cards = [f"{4000 + i} 1111 1111 1111" for i in range(90)]
    rows += [(200 + i, f"card number {c} was charged") for i, c in enumerate(cards)]
    rows += [(400, "card number qq77-8812-x was charged"), (401, "in room b12-444 nothing happened"), (402, "nr. 4111 1111 1111 1111 x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.digest(df).collect()}
    at = len("please reach us via ")
    assert [got[100 + i].spans for i in range(4)] == [f"other:{at}:{at + len(x)}" for x in new[:4]]
    assert got[401].spans == "" and "card:4:23" in got[402].spans
    seeds = spark.createDataFrame([(f"s{i}", True, ["left a"]) for i in range(60)] + [(f"n{i}", False, ["left a", "shape b"]) for i in range(8)] + [("m", False, ["shape b"])], "instance string, seed boolean, patterns array<string>")
    strong = seeds.unionByName(spark.createDataFrame([(f"t{i}", True, ["left a"]) for i in range(200)], seeds.schema))
    assert {r.pattern for r in pii.confident_patterns(strong, rounds=3, confident=0.7).collect()} == {"left a", "shape b"}


def test_toxicity_learns_and_locates(spark):
    texts = [(i, f"plain words number{i} here. quiet text follows" + (". you are a grobnak fool" if i % 3 == 0 else "")) for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.digest(docs, labels).collect()}
    assert all(got[i].predicted == (i % 3 == 0) for i in range(300)) and any(r.held_out for r in got.values())
    a, b = map(int, got[3].offending.split(":"))
    assert "grobnak" in texts[3][1][a:b]


def test_fingerprints_are_local_and_equal():
    rng = np.random.default_rng(2)
    a = " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(400))
    f = fingerprints.fingerprints([a, a, "zzz " + a, a[:1800], "", "", "q"])
    near = lambda i, j: float(fingerprints.likeness(f[i : i + 1], f[j : j + 1])[0])
    assert near(0, 1) == 1.0 and near(0, 2) > 0.85 and 0.4 < near(0, 3) < 0.9 and near(4, 5) == 1.0 and near(0, 6) < 0.1


def test_equal_texts_have_equal_fingerprints_whatever_stands_beside():
    rng = np.random.default_rng(7)
    texts = ["".join(chr(97 + c) for c in rng.integers(0, 6, rng.integers(1, 80))) for _ in range(300)] + ["a", "ab", "aab", "q"]
    alone = np.concatenate([fingerprints.fingerprints([t]) for t in texts])
    for _ in range(3):
        order = rng.permutation(len(texts))
        assert (fingerprints.fingerprints([texts[i] for i in order]) == alone[order]).all()


def test_mix_comes_near_its_targets(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "w " * int(rng.integers(1, 200)), f"s{int(rng.integers(0, 6)) // 2}") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.drawn(df).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r.source, [r.target, 0])[1] += r.size * r.copies
        assert r.copies <= 2
    assert all(abs(t - k) <= 0.01 * t for t, k in by.values())
    assert abs(sum(t for t, _ in by.values()) - 1.5 * sum(r.size for r in got)) < 1
