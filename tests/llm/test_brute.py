"""Queries that SQL cannot express, held against plain loops."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siteloom.llm import chosen_path, components, fingerprints, line_dedup, mixing, packing, pii, quality, range_coder, separator_scan, shingles, toxicity
from siteloom.llm.common import hot_join, keep
from siteloom.llm.queries import BYTE_BPE, END_OF_TEXT, WORD_BPE

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string"
#: Nulls, empty texts, rows that share an id, equal rows, sparse and negative ids.
ODD = [(None, None), (None, None), (None, "b ü c"), (None, "b ü c"), (5, ""), (5, "x y z"), (5, "x y z"), (-(10**12), "short"),
       (10**15, "a much longer text of words " * 40), (7, "aé日𝒳 " * 30), (8, "\n\n"), (9, None)]


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    return rows, spark.createDataFrame(rows, COLUMNS)


def plain_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c in "0123456789"][::-1]
        luhn = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(digits))
        if 13 <= len(digits) <= 19 and luhn % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_base_spans_by_brute_force(spark, documents):
    made = ["10.0.0.1 and 192.168.0.10", "0.0.0.0", "010.001.000.009 256.1.1.1 1.2.3.4.5.6.7.8", "00000000000000000000000255.1.1.1", "1.2.3 1.2.3.0.",
            "a@b.c@d.e_f@g.h x@y x@y@z.com", "4111 1111 1111 1111-4111-1111-1111-1112", "card 4111111111111111 5500-0000-0000-0004", "+49 (30) 1234-5678 +1 2 +12345678901234567",
            "é 10.0.0.1 日𝒳 a.b+c%d@mail-x.co.uk, ++49 170 1234567.", "", None, "0" * 500 + ".1.1.1", "+" * 300 + "1 555 555 5555"]
    rows = documents[0] + [(10_000 + i, t) for i, t in enumerate(made)]
    got = {r.doc_id: r for r in pii.digest(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert len(got) == len(rows)
    found = 0
    for i, text in rows:
        want = plain_spans(text or "")
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(w[0] == k for w in want) for k in ("email", "ip", "card", "phone")), (i, text)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and (r.spans == joined or r.spans.startswith(joined + ",") or not joined)
        found += len(want)
    assert found > 20


def test_discovery_of_planted_identifiers(spark):
    """Recall and precision of a kind that the base lacks, in the context that secrets induce and in none."""
    rng = np.random.default_rng(6)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 6))
    digits = lambda n: "".join(str(c) for c in rng.integers(0, 10, n))
    rows, planted, clean = [], {}, set()
    for i in range(400):
        before, after = " ".join(word() for _ in range(20)), " ".join(word() for _ in range(20))
        if i % 5 < 3:
            found = hashlib.sha1(str(i).encode()).hexdigest()
        elif i % 20 == 3:
            found = f"{word()}-{digits(7)}"
        else:
            # As shaped, but in contexts that no seed has.
            rows.append((i, f"{before} {word()} {word()}-{digits(7)} {after}"))
            clean.add(i)
            continue
        planted[i] = found
        rows.append((i, f'{before} token = "{found}" {after}'))
    got = {r.doc_id: r.spans for r in pii.digest(spark.createDataFrame(rows, COLUMNS)).collect()}
    texts = dict(rows)
    hits = sum(f"other:{texts[i].index(x)}:{texts[i].index(x) + len(x)}" == got[i] for i, x in planted.items())
    assert hits >= 0.95 * len(planted) and sum(got[i] != "" for i in clean) <= 0.02 * len(clean)


@pytest.mark.parametrize("range_rows", [2, 512])
def test_edited_texts_and_following_documents_by_brute_force(spark, documents, range_rows):
    for rows in (documents[0], ODD, ODD[:1], ODD[4:6]):
        order = sorted(rows, key=lambda r: -(r[0] if r[0] is not None else -(2**63)))
        got = fingerprints.digest(spark.createDataFrame(rows, COLUMNS), range_rows).collect()
        assert len(got) == len(rows)
        texts = defaultdict(set)
        for i, t in rows:
            texts[i].add(t or "")
        after = {i: texts[order[(k + 1) % len(order)][0]] | texts[i] for k, (i, _) in enumerate(order)}
        prints = {t: fingerprints.fingerprints([t])[0] for ts in texts.values() for t in ts}
        shown = {p.astype(">u2").tobytes().hex(): t for t, p in prints.items()}
        for r in got:
            own = {t for t in texts[r.doc_id] if prints[t].astype(">u2").tobytes().hex() == r.fingerprint and len(t) == r.n_chars}
            assert own
            pairs = {(fingerprints.edited(a, b), b) for a in own for b in after[r.doc_id]}
            fits = {(e, b) for e, b in pairs if hashlib.sha256(e.encode()).hexdigest() == r.edited_sha256}
            assert fits, r.doc_id
            assert any(abs(fingerprints.likeness(prints[next(iter(own))][None], prints[b][None])[0] - r.near_next) < 1e-9 for _, b in fits)
            assert r.edited_fingerprint in {fingerprints.fingerprints([e])[0].astype(">u2").tobytes().hex() for e, _ in fits}
        assert shown


def test_packed_digest_by_brute_force(spark, documents):
    rows = documents[0] + [(None, None)] * 30 + [(None, "a b")] * 3 + ODD[4:]
    t = Tokenizer.from_file(BYTE_BPE)
    want = defaultdict(list)
    for i, text in rows:
        want[i].append(np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4"))
    got = packing.digest(spark.createDataFrame(rows, COLUMNS), BYTE_BPE, group_bytes=200_000).collect()
    assert sum(r.length for r in got) == sum(len(x) for v in want.values() for x in v)
    by, windows = defaultdict(list), defaultdict(list)
    for r in got:
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in want[r.doc_id])
        by[r.doc_id].append(r)
        windows[r.sequence_id].append((r.offset, r.length))
    for i, parts in by.items():
        if len(want[i]) == 1:
            at = 0
            for r in sorted(parts, key=lambda r: r.start):
                assert r.start == at
                at += r.length
            assert at == len(want[i][0])
    padded = 0
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
        padded += at & (at - 1) != 0
    assert padded * 20 <= len(windows) + 20 * (len(rows) // 20 + 1)


def test_token_counts_by_document(spark, documents):
    t = Tokenizer.from_file(BYTE_BPE)
    rows = documents[0]
    got = separator_scan.digest(spark.createDataFrame(rows, COLUMNS), BYTE_BPE, END_OF_TEXT).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(t.encode(x or "", add_special_tokens=False).ids) + 1 for i, x in rows}
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_token_files_by_document(spark, documents):
    t = Tokenizer.from_file(WORD_BPE)
    rows = documents[0]
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in range_coder.digest(spark.createDataFrame(rows, COLUMNS), WORD_BPE).collect()}
    at, want = 0, {}
    for i, text in sorted(rows):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want[i] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert got == want


def plain_components(rows, k, percent):
    """doc_id -> smallest doc_id reachable, over all pairs of rows; rows that share an id are one vertex."""
    sets = [(i, set(s.tolist())) for (i, _), s in zip(rows, shingles.shingle_sets([shingles.words(t) for _, t in rows], k)) if i is not None]
    low = {i: i for i, _ in rows if i is not None}
    links = {(i, j) for i, a in sets for j, b in sets if i < j and a and b and 100 * len(a & b) >= percent * len(a | b)}
    moved = True
    while moved:
        moved = False
        for i, j in links:
            if low[i] != low[j]:
                low[i] = low[j] = min(low[i], low[j])
                moved = True
    return low, links


def test_near_duplicates_lose_no_link(spark, documents):
    rng = np.random.default_rng(8)
    rows = list(documents[0])
    for i, t in documents[0][:60]:
        w = (t or "").split()
        if len(w) > 30:
            w[int(rng.integers(0, len(w)))] = "changed"
            rows.append((20_000 + i, " ".join(w)))
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows += [(30_003, a), (30_009, a), (30_009, b), (30_020, b.replace("b30", "zz"))]
    low, links = plain_components(rows, 4, 80)
    assert len(links) > 20 and low[30_020] == 30_003
    got = chosen_path.digest(spark.createDataFrame(rows, COLUMNS)).collect()
    assert [(r.doc_id, r.component_id) for r in got if low[r.doc_id] != r.component_id] == []


def test_one_row_of_each_group_stays(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(3, a), (9, a), (9, b), (20, b.replace("b30", "zz")), (20, ""), (21, ""), (22, None), (None, a), (None, "x y z"), (None, "x y z"), (30, "q r s"), (30, "q r s"), (31, "u v")]
    df = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "'k' AS doc", "1 AS print")
    out = chosen_path.apply(df)
    assert out.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(
        [(3, a), (20, ""), (21, ""), (22, None), (None, "x y z"), (30, "q r s"), (31, "u v")], key=repr)
    assert chosen_path.apply(df.limit(0)).collect() == []


def test_quality_measures_of_odd_texts(spark):
    long = " ".join(f"w{i % 700}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t\n "), (4, "a b c d e f g h i j k"), (5, "x\nx\n x\nx\n\n\n"), (6, "one two three four five one two three four five six"), (7, long), (8, "#a $b |c <d> e& f* g% h i j k l"),
            (9, "é日 𝒳 " * 40), (None, "a a a a a a a a a a a a"), (10, "same line here\nsame line here\nother"), (10, "same line here\nsame line here\nother")]
    got = quality.digest(spark.createDataFrame(rows, COLUMNS)).collect()

    def want(text):
        text = text or ""
        words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", text) if w]
        seen, dup = set(), 0
        for line in text.split("\n"):
            if line.strip(" \t\x0b\x0c\r"):
                dup += line in seen
                seen.add(line)
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        count = defaultdict(int)
        for w in windows:
            count[w] += 1
        covered = {i + j for i, w in enumerate(windows) if count[w] > 1 for j in range(5)}
        n = len(words)
        return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 10 or 100 * len(covered) > 20 * n

    measured = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=repr)
    assert measured == sorted(((i, *want(t)) for i, t in rows), key=repr)
    assert not any(r.kept for r in got if r.base_failed) and quality.digest(spark.createDataFrame([], COLUMNS)).collect() == []


def test_bare_draws_would_mix_otherwise(spark):
    """The odds decide the order: ranked by the bare draw, other documents would be taken."""
    rng = np.random.default_rng(4)
    rows = [(i, "w " * int(rng.integers(1, 400)), f"s{i % 5}") for i in range(2000)]
    got = [r for r in mixing.drawn(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()]
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    other = 0
    for part in by.values():
        floor = min(r.copies for r in part)
        taken = sum(r.size for r in part if r.copies > floor)
        at, bare = 0, set()
        for r in sorted(part, key=lambda r: r["__u"]):
            if at + r.size <= taken:
                at += r.size
                bare.add(r.doc_id)
            else:
                break
        other += len(bare ^ {r.doc_id for r in part if r.copies > floor})
        # Long documents are the likelier ones.
        if 0 < taken < sum(r.size for r in part):
            assert np.mean([r.size for r in part if r.copies > floor]) > np.mean([r.size for r in part if r.copies == floor])
    assert other > 100


def test_mix_of_odd_rows(spark):
    rows = [(None, "a b c", None), (None, "a b c", None), (1, None, "s"), (2, "", "s"), (3, "x " * 50, "s"), (3, "x " * 50, "s"), (4, "y " * 7, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.digest(df).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in got)
    assert {(r.doc_id, r.size, r.source_size) for r in got} == {(None, 3, 6), (1, 0, 100), (2, 0, 100), (3, 50, 100), (4, 7, 7)}
    again = mixing.digest(df.repartition(3)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    out = mixing.apply(df.selectExpr("*", "1 AS size", "'x' AS __f", "2 AS copies"))
    assert out.columns == ["doc_id", "text", "source", "size", "__f", "copies"]


def test_dedup_of_odd_lines(spark):
    line = "A line that is long enough to be counted, é日𝒳"
    rows = [(i, f"{line}\nown {i}") for i in range(4)] + [(None, f"  {line.upper().replace('É', 'é')}\t"), (9, None), (10, ""), (11, f"{line}\n{line}\n\n"), (11, f"{line}\n{line}\n\n"), (12, "short\nshort")]
    got = line_dedup.digest(spark.createDataFrame(rows, COLUMNS)).collect()
    want = []
    for i, text in rows:
        lines = (text or "").split("\n")
        left = lines if i == 11 or i in (9, 10, 12) else [x for x in lines if "own" in x]
        want.append((i, len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got), key=repr) == sorted(want, key=repr)


def test_toxicity_scores_by_plain_loops(spark, documents, monkeypatch):
    features = ["the", "tha-", "-ion", "de", "-ent", "grobnak", "ung-"]
    weights, bias, leak = np.array([0.4, -0.3, 0.9, 0.2, 0.7, 6.0, 0.5]), -2.5, 0.03
    monkeypatch.setattr(toxicity, "train", lambda *_: toxicity.Model(features, weights, bias, leak))
    rows = documents[0][:120] + [(None, "you grobnak"), (9_001, None), (9_002, ""), (9_003, "Grobnak! the\nUNGe. x? " * 50), (9_003, "ÜNG"), (9_004, "...")]
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.digest(spark.createDataFrame(rows, COLUMNS), labels).collect()
    assert len(got) == len(rows)
    seen = defaultdict(list)
    for i, text in rows:
        clean, bad = 1 - leak, []
        for m in re.finditer(r"[^.!?\n]+", text or ""):
            held = {f for w in re.findall(r"[^\W\d_]+", m[0].lower()) for f in (w, *(x for n in (3, 4, 5) if len(w) > n for x in (w[:n] + "-", "-" + w[-n:])))} & set(features)
            if held:
                p = 1 / (1 + np.exp(-(bias + sum(weights[features.index(f)] for f in held))))
                clean *= 1 - p
                bad += [f"{m.start()}:{m.end()}"] if p >= 0.5 else []
        seen[i].append((1 - clean, ",".join(bad)))
    for r in got:
        assert any(abs(r.score - s) < 1e-9 and r.offending == b for s, b in seen[r.doc_id])
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5)
    assert {r.predicted for r in got} == {0, 1} and toxicity.digest(spark.createDataFrame([], COLUMNS), labels).collect() == []


def test_toxicity_never_trains_on_held_out_rows(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(300)] + [(None, "x"), (7, None)], COLUMNS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(7, 1), (5, None), (None, 1)], "doc_id long, toxic int")
    ids = {r.text for r in toxicity.training_rows(docs, labels).collect()}
    assert ids == {f"text {i}" for i in range(300) if zlib.crc32(str(i).encode()) % 5} | ({""} if zlib.crc32(b"7") % 5 else set())
    assert toxicity.training_rows(docs, labels, 50).count() <= 60


def test_beyond_the_counted_bounds(spark):
    """The ways for tables that are counted large give what those for small ones give."""
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (260, 2)) if a != b]
    df = keep(spark.createDataFrame(links, "a long, b long"), "test-links")
    one, two = ({r.v: r.c for r in components.components(df, few).collect()} for few in (500_000, 0))
    low = {v: v for pair in links for v in pair}
    for _ in low:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    assert one == two == low
    rows = spark.createDataFrame([(i, 0 if i % 2 else i) for i in range(400)], "i long, k long")
    keys = keep(rows.groupBy("k").agg(F.count("*").alias("n")).where("k % 3 = 0"), "test-keys")
    key = lambda x: sorted(map(tuple, x.select("i", "k", "n").collect()))
    assert key(hot_join(rows, keys, ["k"], "n")) == key(hot_join(rows, keys, ["k"], "n", few=0)) != []
    ids = spark.range(3000).select(F.col("id").alias("doc"), F.xxhash64("id").alias("print"))
    low_doc, low_print = fingerprints.bounds(ids, 10, 30)
    assert 20 <= len(low_doc) == len(low_print) <= 29 and (np.diff(low_doc) > 0).all()


def test_near_duplicates_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "FEW", 0)
    monkeypatch.setattr(components, "FEW_LINKS", 0)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i, k in enumerate(rng.integers(0, 80, 14).tolist())] + [(i, " ".join(f"{i}_{j}" for j in range(30))) for i in range(20, 26)] + [(30, None)]
    low, _ = plain_components(rows, 4, 80)
    got = {r.doc_id: r.component_id for r in chosen_path.digest(spark.createDataFrame(rows, COLUMNS), leaf=4, levels=2).collect()}
    assert got == low


def edited_copies(rng, n):
    """Copies of one text with up to 14 words changed, about half of them too many for a link with the others."""
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(n):
        w = list(base)
        for k in rng.integers(0, 150, int(rng.integers(0, 15))).tolist():
            w[k] = f"x{rng.integers(0, 40)}"
        rows.append((i, " ".join(w)))
    return rows


def test_a_large_group_meets_its_blocks_once(spark, monkeypatch):
    rows = edited_copies(np.random.default_rng(4), 300)
    low, _ = plain_components(rows, 4, 80)
    assert 20 < len(set(low.values())) < 280
    counted, blocks = [], chosen_path._blocks

    def count(*a):
        counted.append(blocks(*a).count())
        return blocks(*a)

    monkeypatch.setattr(chosen_path, "_blocks", count)
    got = {r.doc_id: r.component_id for r in chosen_path.digest(spark.createDataFrame(rows, COLUMNS), leaf=16).collect()}
    assert got == low
    # Not with every node of every tree, nor with a block of each 16 classes.
    assert len(counted) == 1 and counted[0] <= 2 * len(rows)


def test_blocks_of_a_large_group_lose_no_link(spark, monkeypatch):
    rows = edited_copies(np.random.default_rng(6), 150)
    rows += [(1000 + i, t.replace("w", "v")) for i, t in edited_copies(np.random.default_rng(7), 60)]
    low, _ = plain_components(rows, 4, 80)
    df = spark.createDataFrame(rows, COLUMNS)
    for few in (0, 200_000):
        monkeypatch.setattr(chosen_path, "FEW", few)
        monkeypatch.setattr(chosen_path, "FEW_PAIRS", few)
        assert {r.doc_id: r.component_id for r in chosen_path.digest(df, leaf=8, block=20).collect()} == low
    monkeypatch.setattr(chosen_path, "BLOCK_SHINGLES", 147 * 30)
    assert {r.doc_id: r.component_id for r in chosen_path.digest(df, leaf=8).collect()} == low


@pytest.mark.parametrize("rare,strip", [(32, 2_000_000), (2, 100), (0, 1), (10_000, 700)])
def test_shared_shingles_equal_plain_sets(monkeypatch, rare, strip):
    monkeypatch.setattr(chosen_path, "RARE", rare)
    monkeypatch.setattr(chosen_path, "STRIP", strip)
    rng = np.random.default_rng(3)
    common = rng.integers(0, 2**63, 1300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(common, int(rng.integers(0, 1200))), rng.integers(0, 60, int(rng.integers(1, 9)), dtype=np.uint64)])) for _ in range(50)]
    sets[7] = np.array([2**62], np.uint64)
    left = np.array([0, 3, 7, 8, 49])
    got = list(chosen_path._counts(np.concatenate(sets), np.array([len(s) for s in sets]), left))
    assert np.concatenate([p for p, _ in got]).tolist() == left.tolist()
    shared = np.concatenate([c for _, c in got]).astype(int)
    assert all(shared[k, j] == len(np.intersect1d(sets[i], sets[j])) for k, i in enumerate(left) for j in range(len(sets)) if i != j)
    alone = [np.array([i], np.uint64) for i in range(3)]
    assert np.concatenate([c for _, c in chosen_path._counts(np.concatenate(alone), np.ones(3, int), np.arange(3))]).sum() == 0


def test_separators_of_plain_files(spark, tmp_path):
    rng = np.random.default_rng(9)
    want, base = [], 0
    for name, n in (("a.bin", 1000), ("b.bin", 0), ("c.bin", 777)):
        ids = rng.integers(0, 12, n).astype("<u2")
        (tmp_path / name).write_bytes(ids.tobytes())
        ends = [*(np.flatnonzero(ids == 5) + 1).tolist()]
        ends += [n] if n and (not ends or ends[-1] < n) else []
        want += [(base + a, b - a, bool(ids[b - 1] == 5)) for a, b in zip([0, *ends], ends)]
        base += n
    blocks = separator_scan.flat_files(spark, f"file://{tmp_path}/*.bin", block_bytes=64)
    assert sorted((r.start, r.n_tokens, r.ended) for r in separator_scan.scan(blocks, 5).collect()) == sorted(want)
