"""The stages of the pipeline in sequence, each held against a plain loop over what its predecessor kept."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from siteloom.llm import shingles, toxicity
from siteloom.llm.queries import BYTE_BPE

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
LINE = "subscribe to our letter and never miss another update again"


def made():
    rng = np.random.default_rng(12)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(600)]
    rows, labels = [], []
    for i in range(260):
        text = ". ".join(" ".join(rng.choice(words, 9)) for _ in range(int(rng.integers(2, 14))))
        if i % 9 == 0:
            text += ". you grobnak zilch fool"
        if i % 7 == 0:
            text = f"{text}\n  {LINE.upper() if i % 2 else LINE}\nlast words {i}"
        rows.append([i, text, "en", f"s{i % 5}" if i % 31 else None, None])
        if i % 3 != 2:
            labels.append((i, int(i % 9 == 0)))
    for k in range(40):
        w = rows[k][1].split(" ")
        if k % 2 and len(w) > 40:
            w[3] = "edited"
        rows.append([1000 + k, " ".join(w), "en", "s1", 1])
    rows += [[2000, None, None, None, None], [2001, "", "en", "s2", 0], [None, "no id at all here", "en", "s3", 4]]
    return [tuple(r) for r in rows], labels


def plain_dedup(rows):
    key = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40:
                held[key(line)].add(-math.inf if i is None else i)
    often = {k: max(v) for k, v in held.items() if len(v) >= 5}
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if often.get(key(x), i) == i]
        out.append((i, text if len(left) == len(lines) else "\n".join(left)))
    return out


def plain_representatives(rows):
    sets = [(i, t, set(s.tolist())) for (i, t), s in zip(rows, shingles.shingle_sets([shingles.words(t) for _, t in rows], 5))]
    low = {i: i for i, _, _ in sets if i is not None}
    for _ in sets:
        moved = False
        for i, _, a in sets:
            for j, _, b in sets:
                if i is not None and j is not None and i != j and a and b and low[i] != low[j] and 100 * len(a & b) >= 80 * len(a | b):
                    low[i] = low[j] = min(low[i], low[j])
                    moved = True
        if not moved:
            break
    return {i for i, v in low.items() if i == v} | {None}


def plain_mix(rows, sources):
    """Copies by doc_id: the rules of the mix in exact order, over lists."""
    size = {i: len((t or "").split()) for i, t in rows}
    by = defaultdict(list)
    for i, _ in rows:
        by[sources[i]].append(i)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    words = {s: sum(size[i] for i in by[s]) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, target, open_ = 1.5 * sum(words.values()), {}, set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * words[s]}
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in full:
            target[s] = 2.0 * words[s]
            left -= target[s]
        open_ -= full
    copies = {}
    for s in names:
        whole = math.floor(target[s] / words[s]) if words[s] else 0
        rest, some = target[s] - whole * words[s], [i for i in by[s] if size[i]]
        copies |= {i: whole for i in by[s]}
        while some:
            rate = rest / sum(size[i] ** 2 for i in some)
            sure = [i for i in some if size[i] == max(size[x] for x in some) and size[i] * rate >= 1]
            if not sure:
                break
            for i in sure:
                copies[i] += 1
                rest -= size[i]
            some = [i for i in some if i not in sure]
        if not some or rest <= 0:
            continue
        odds = {}
        for i in some:
            key = str(i) if i is not None else hashlib.md5(dict(rows)[i].encode()).hexdigest()
            u = (int(hashlib.md5(f"mix:{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            p = size[i] * rate
            odds[i] = (u / (1 - u)) / (p / (1 - p))
        taken = 0
        order = sorted(some, key=odds.get)
        while order and taken + size[order[0]] <= rest:
            taken += size[order[0]]
            copies[order.pop(0)] += 1
        lack = rest - taken
        fill = min(order, key=lambda i: (abs(lack - size[i]), odds[i]), default=None)
        if fill is not None and abs(lack - size[fill]) < lack:
            copies[fill] += 1
    return copies


def test_stages_in_sequence(spark, tmp_path):
    rows, labels = made()
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, sources = spark.read.parquet(f"{tmp_path}/documents.parquet"), {r[0]: r[3] for r in rows}
    stage = dict(corpus_pipeline.STAGES)

    clean = stage["toxicity"](spark, docs, str(tmp_path))
    scores = {r.doc_id: r.score for r in toxicity.digest(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()}
    got = {r.doc_id for r in clean.collect()}
    assert clean.columns == docs.columns and got == {i for i, s in scores.items() if s < 0.5}
    planted = {r[0] for r in rows if r[1] and "grobnak" in r[1]}
    assert got & planted == set() and len(got) == len(rows) - len(planted)

    kept = [(r.doc_id, r.text) for r in clean.collect()]
    deduped = stage["line_dedup"](spark, clean, str(tmp_path))
    lines = [(r.doc_id, r.text) for r in deduped.collect()]
    assert deduped.columns == docs.columns and sorted(lines, key=repr) == sorted(plain_dedup(kept), key=repr)
    assert sum(LINE in (t or "").lower() for _, t in lines) == 1

    single = stage["near_dedup"](spark, deduped, str(tmp_path))
    alone = [(r.doc_id, r.text) for r in single.collect()]
    assert single.columns == docs.columns and {i for i, _ in alone} == plain_representatives(lines) and len(alone) == len({i for i, _ in alone}) < len(lines)

    mixed = stage["mixing"](spark, single, str(tmp_path))
    copies = plain_mix(alone, sources)
    assert mixed.columns == docs.columns and Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in copies.items() if n})

    t = Tokenizer.from_file(BYTE_BPE)
    packed = stage["packing"](spark, mixed, str(tmp_path)).collect()
    want = sum(n * (len(t.encode(x or "", add_special_tokens=False).ids) + 1) for i, x in alone if (n := copies[i]))
    assert sum(r.length for r in packed) == want

    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sum(r.length for r in whole.collect()) == want


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
