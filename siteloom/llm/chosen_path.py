"""MinHash near-duplicates by the chosen-path set similarity join.

Every distinct sequence of words is one class, numbered by a row that holds it. A class has 128 minwise tokens of
its shingle set. A tree starts from the empty path; at each node a hash of the path chooses one or two of the 128
positions (1.25 on average, the inverse of the similarity), and a class goes on to the node of the path extended by
the position and its token there. Nodes of one class end; nodes of at most `leaf` classes are compared exhaustively by
their tokens; larger ones branch again. `trees` independent trees are grown: a pair at the threshold shares a node of
the first two levels of one tree with probability 0.73, of eight trees with 0.99997; a pair that shares more does so
more surely. Levels beyond the second are met only in groups of more than `leaf` classes; there a node always chooses
two positions, 1.6 shared children on average at the threshold, so that a pair's chance does not fall with the depth:
eight trees meet it with 0.99995 on the third level and with more than 0.9999 on any (positions taken as independent).

Candidates are pairs of a node whose tokens agree in at least 0.8 less 5 standard errors. Links are confirmed on full
shingle sets, inside the node. Only connectivity is wanted, so a pair within a component that is confirmed already isn't
looked at: the first tree is confirmed alone, the others then only between different components, and a node reports
at most one link less than it has classes. Pairs never become rows.

Nodes that are still larger than `leaf` on the last level are held together by their hubs before all else, the class
nearest to the most frequent tokens (of edited copies their original). As one group of copies makes large nodes in every
tree, those whose hubs are in one component then are one group, and what is in other components than the group's largest
is compared with all of the group, block by block, on full sets and once, so no pair is lost. The trees don't look again
at pairs of a group. A class of a group becomes one row for every block it meets, of up to `block` classes: at most two
in a group of up to `block`, whatever its number of nodes.

Edge cases: documents without words (null and empty texts too) are linked with nothing and are their own component; a
null doc_id has a null component and is kept; a class that only null ids hold is linked with nothing; rows that share a
doc_id are one vertex, so their classes are linked; repeated rows and ties give equal results; an empty table gives an
empty table; only doc_id and text are read, so other columns cannot clash.

Scale: texts are read where they lie, and those of classes with candidates are found by a broadcast of their ids if
these are counted few, else by a shuffle join; signatures (512 bytes a class) and, for classes that have candidates,
shingle sets are what is shuffled. A task holds one leaf or one pair of blocks at a time. Nothing is collected but counts.
Beyond `block` classes the rows of a group still grow with its size times the number of its blocks, and the pairs compared
inside of tasks with the size times what the hub does not hold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, release, small
from .components import components
from .shingles import POSITIONS, mix, sequence_key, shingle_sets, signatures, words

WORDS, PERCENT, TREES, LEAF, LEVELS, BLOCK = 4, 80, 8, 1024, 3, 8192
#: Shingles of a block; of longer texts it has fewer classes, down to `leaf`.
BLOCK_SHINGLES = 4_000_000
#: Candidates of a cell that are confirmed one by one; more of them by products of matrices.
FEW_PAIRS = 64
#: Classes that have a shingle, up to which they are counted by lists, and cells of a strip of counts.
RARE, STRIP = 32, 2_000_000
#: Ids of texts, or of rows, that are broadcast at most.
FEW = 200_000
_CELL = ("cell", "vid", "comp", "grp", "side", "n", "sig")
_U = np.uint64


def _prepare(k: int):
    def prepare(batches):
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, prints, texts = (batch.column(c) for c in ("doc", "print", "text"))
            texts = texts.to_pylist()
            for at in range(0, len(texts), 256):
                found = [words(t) for t in texts[at : at + 256]]
                sets = shingle_sets(found, k)
                full = [i for i, s in enumerate(sets) if len(s)]
                sig = dict(zip(full, signatures([sets[i] for i in full]))) if full else {}
                yield pa.record_batch([
                    ids.slice(at, 256), prints.slice(at, 256), pa.array(np.arange(row, row + len(found))),
                    pa.array([sequence_key(f) if f else None for f in found], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([sig[i].tobytes() if i in sig else None for i in range(len(sets))], pa.binary()),
                ], names=["doc", "print", "row", "cls", "n", "sig"])
                row += len(found)

    return prepare


def _branch(paths: np.ndarray, rows: np.ndarray, sigs: np.ndarray, first: np.ndarray, both: bool):
    """Paths of the children, the row of each, and what their parents have as first; both: always two positions."""
    out_p, out_r, out_f = [], [], []
    draw = mix(paths ^ _U(0xA5A5A5A5A5A5A5A5))
    for salt in (0, 1):
        pick = mix(draw + _U(salt + 1))
        go = np.ones(len(paths), bool) if salt == 0 or both else (draw >> _U(62)) == 0
        position = (pick % _U(POSITIONS)).astype(np.int64)[go]
        token = sigs[rows[go], position].astype(_U)
        out_p.append(mix(mix(paths[go] + _U(0x632BE59BD9B4E019) * (position.astype(_U) + _U(1))) ^ token))
        out_r.append(rows[go])
        out_f.append(first[go])
    return np.concatenate(out_p), np.concatenate(out_r), np.concatenate(out_f)


def _grow(trees: int | None, both: bool = False):
    """Rows (vid, sig[, node, first]) to rows (node, vid, first tree); trees: how many to start, None to go on from node."""

    def grow(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u4").reshape(-1, POSITIONS)
            vids = batch.column("vid").to_numpy()
            if trees:
                paths, rows = np.tile(mix(np.arange(1, trees + 1, dtype=_U)), len(vids)), np.repeat(np.arange(len(vids)), trees)
                first = np.tile(np.arange(trees) == 0, len(vids))
            else:
                paths, rows = batch.column("node").to_numpy(zero_copy_only=False).astype(np.int64).view(_U), np.arange(len(vids))
                first = batch.column("first").to_numpy(zero_copy_only=False).astype(bool)
            paths, rows, first = _branch(paths, rows, sigs, first, both)
            yield pa.record_batch([pa.array(paths.view(np.int64)), pa.array(vids[rows]), pa.array(first)], names=["node", "vid", "first"])

    return grow


def _groups(batches, key: str):
    """(key, rows as columns) for runs of equal keys in sorted batches; a run may reach over batches."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        keys = table.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-2], cuts[1:-1]):
            yield keys[a], table.slice(a, b - a)
        held = table.slice(cuts[-2])
    if held is not None and held.num_rows:
        yield held.column(key)[0].as_py(), held


def _near(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int, after: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices i, j and equal tokens of the pairs that may be similar enough, by sizes and tokens; after: j > i only."""
    least = (percent / 100 - 5 * (percent / 100 * (1 - percent / 100) / POSITIONS) ** 0.5) * POSITIONS
    left, right, same = [], [], []
    for i in range(len(a)):
        at = i + 1 if after else 0
        fits = at + np.flatnonzero(100 * np.minimum(nb[at:], na[i]) >= percent * np.maximum(nb[at:], na[i]))
        if len(fits):
            equal = (b[fits] == a[i]).sum(1)
            good = equal >= least
            left.append(np.full(int(good.sum()), i, np.int32))
            right.append(fits[good].astype(np.int32))
            same.append(equal[good].astype(np.int16))
    if not left:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int16)
    return np.concatenate(left), np.concatenate(right), np.concatenate(same)


def _possible(t: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """i, j, equal tokens of a cell's pairs in different components and groups."""
    n, comp, grp = (t.column(c).to_numpy() for c in ("n", "comp", "grp"))
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), "<u4").reshape(-1, POSITIONS)
    i, j, e = _near(sig, sig, n, n, percent, True)
    apart = (comp[i] != comp[j]) & (grp[i] != grp[j])
    return i[apart], j[apart], e[apart]


def _counts(flat: np.ndarray, n: np.ndarray, left: np.ndarray):
    """(some of left, shingles they share with every other set) strip by strip; flat: the sets of sizes n one after another."""
    _, token, df = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(n)), n)
    # A shingle of a single set is in no intersection.
    several = df[token] > 1
    token, owner = token[several], owner[several]
    often = df > RARE
    dense, column = owner[often[token]], (np.cumsum(often) - 1)[token[often[token]]]
    order = np.argsort(column, kind="stable")
    dense, column = dense[order], column[order]
    rare, whose = token[~often[token]], owner[~often[token]]
    order = np.argsort(rare, kind="stable")
    lists, first = whose[order], np.searchsorted(rare[order], np.arange(len(df)))
    begin = np.searchsorted(whose, np.arange(len(n) + 1))
    step = max(1, STRIP // len(n))
    for at in range(0, len(left), step):
        part = left[at : at + step]
        entries = np.concatenate([np.arange(begin[i], begin[i + 1]) for i in part])
        long = df[rare[entries]]
        row = np.repeat(np.repeat(np.arange(len(part)), begin[part + 1] - begin[part]), long)
        member = lists[np.repeat(first[rare[entries]] - np.cumsum(long) + long, long) + np.arange(long.sum())]
        counts = np.bincount(row * len(n) + member, minlength=len(part) * len(n)).reshape(len(part), len(n)).astype(np.float32)
        for c in range(0, int(column[-1]) + 1 if len(column) else 0, 1024):
            a, b = np.searchsorted(column, (c, c + 1024))
            held = np.zeros((len(n), min(1024, int(column[-1]) + 1 - c)), np.float32)
            held[dense[a:b], column[a:b] - c] = 1
            counts += held[part] @ held.T
        yield part, counts


def _united(t: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Links i, j that join the components of a cell, on full sets; side 0 meets 1 and 2, side 1 meets 0 and 2."""
    sets = t.column("set").to_pylist()
    n = np.array([len(s) // 8 for s in sets])
    _, comp = np.unique(t.column("comp").to_numpy(), return_inverse=True)
    side, out = t.column("side").to_numpy(), []
    for part, counts in _counts(np.frombuffer(b"".join(sets), "<u8"), n, np.flatnonzero(side != 1)):
        similar = 100 * counts.astype(np.int64) >= percent * (n[part][:, None] + n - counts.astype(np.int64))
        similar &= (side[part][:, None] == 2) | (side != 0)
        for i, row in zip(part.tolist(), similar):
            found = np.flatnonzero(row & (comp != comp[i]))
            if len(found):
                others, at = np.unique(comp[found], return_index=True)
                out += [(i, j) for j in found[at].tolist()]
                comp[np.isin(comp, others)] = comp[i]
    return out


def _compare(percent: int):
    """Sorted rows (cell, vid, comp, side, set) to links a < b that join different components."""

    def compare(batches):
        for _, t in _groups(batches, "cell"):
            if t.num_rows > 1 and (found := _united(t, percent)):
                vid = t.column("vid").to_numpy()
                pairs = np.sort(vid[np.array(found)], axis=1)
                yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return compare


def _wanted(percent: int):
    """Sorted rows (cell, vid, comp, grp, side, n, sig) to those that have a candidate in their cell."""

    def wanted(batches):
        for _, t in _groups(batches, "cell"):
            if t.num_rows > 1:
                i, j, _ = _possible(t, percent)
                if len(i):
                    yield from t.take(np.union1d(i, j)).to_batches()

    return wanted


def _confirm(percent: int):
    """Sorted rows (cell, vid, comp, grp, side, n, sig, set) to links a < b that join different components."""

    def confirm(batches):
        a_out, b_out = [], []
        for _, t in _groups(batches, "cell"):
            vid, comp = t.column("vid").to_pylist(), t.column("comp").to_pylist()
            sets = t.column("set")
            read = lambda i: np.frombuffer(sets[i].as_buffer(), "<u8")
            up: dict = {}

            def root(c):
                while c in up:
                    c = up[c]
                return c

            left, right, equal = _possible(t, percent)
            if len(left) > FEW_PAIRS:
                for i, j in _united(t, percent):
                    a_out.append(min(vid[i], vid[j]))
                    b_out.append(max(vid[i], vid[j]))
                continue
            for k in np.argsort(-equal, kind="stable"):
                i, j = int(left[k]), int(right[k])
                c, d = root(comp[i]), root(comp[j])
                if c != d:
                    one, two = read(i), read(j)
                    both = len(np.intersect1d(one, two, assume_unique=True))
                    if 100 * both >= percent * (len(one) + len(two) - both):
                        up[c] = d
                        a_out.append(min(vid[i], vid[j]))
                        b_out.append(max(vid[i], vid[j]))
        yield pa.record_batch([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    return confirm


def _cells(classes: DataFrame, trees: int, leaf: int, levels: int) -> tuple[DataFrame, DataFrame | None]:
    """Kept rows (cell, vid, first) of the nodes small enough to compare, and (node, vid) of the others on the last level."""
    at = classes.select("vid", "sig").mapInArrow(_grow(trees), "node long, vid long, first boolean")
    cells, large = [], None
    for level in range(1, levels + 1):
        sizes = at.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
        rows = keep(at.join(sizes, "node"), "level")
        cells.append(rows)
        big = rows.where(F.col("size") > leaf)
        if big.isEmpty():
            break
        if level == levels:
            large = keep(big.select("node", "vid").distinct(), "large")
            break
        # Kept, as it is read twice: for the sizes of the nodes and for their rows.
        at = keep(big.select("node", "vid", "first").join(classes, "vid").mapInArrow(_grow(None, level >= 2), "node long, vid long, first boolean"), "nodes")
    every = cells[0]
    for c in cells[1:]:
        every = every.unionByName(c)
    return every.where(F.col("size") <= leaf).select(F.col("node").alias("cell"), "vid", "first").distinct(), large


def _modes(batches):
    """Rows (node, sig) sorted by node to each node's most frequent token of every position."""
    for node, t in _groups(batches, "node"):
        sig = np.sort(np.frombuffer(b"".join(t.column("sig").to_pylist()), "<u4").reshape(-1, POSITIONS), axis=0)
        mode = []
        for column in sig.T:
            values, counts = np.unique(column, return_counts=True)
            mode.append(values[counts.argmax()])
        yield pa.record_batch([pa.array([node], pa.int64()), pa.array([np.array(mode, "<u4").tobytes()], pa.binary())], names=["node", "mode"])


def _agreement(batches):
    """Rows (node, vid, sig, mode) to (node, vid, equal tokens)."""
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(-1, POSITIONS) for c in ("sig", "mode"))
            yield pa.record_batch([batch.column("node"), batch.column("vid"), pa.array((a == b).sum(1), pa.int64())], names=["node", "vid", "equal"])


def _hubs(large: DataFrame, classes: DataFrame, leaf: int) -> DataFrame:
    """node, hub: the class that agrees most with the most frequent tokens of about `leaf` classes of the node."""
    sigs = classes.select("vid", "sig")
    rows = large.join(sigs, "vid")
    share = large.groupBy("node").agg(F.ceil(F.count("*") / leaf).alias("parts"))
    some = large.join(share, "node").where(F.pmod(F.xxhash64("vid"), F.col("parts")) == 0).join(sigs, "vid").select("node", "sig")
    modes = keep(some.repartition("node").sortWithinPartitions("node").mapInArrow(_modes, "node long, mode binary"), "modes")
    near = rows.join(modes, "node", "left").select("node", "vid", "sig", F.coalesce("mode", "sig").alias("mode"))
    near = near.mapInArrow(_agreement, "node long, vid long, equal long")
    return near.groupBy("node").agg((-F.max(F.struct("equal", (-F.col("vid")).alias("low")))["low"]).alias("hub"))


def _star(near: DataFrame, leaf: int) -> DataFrame:
    """Rows (cell, vid, comp, side) that bring every class of rows (hub, vid) together with the hub, some `leaf` in a cell."""
    parts = near.groupBy("hub").agg(F.ceil(F.count("*") / leaf).cast("int").alias("parts"))
    cell = lambda part: F.xxhash64("hub", part)
    own = parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    own = own.select(cell("part").alias("cell"), F.col("hub").alias("vid"), F.lit(0).alias("side"))
    rest = near.where("hub <> vid").join(parts, "hub").withColumn("part", F.pmod(F.xxhash64("vid"), F.col("parts")).cast("int"))
    return own.unionByName(rest.select(cell("part").alias("cell"), "vid", F.lit(1).alias("side")))


def _named(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with their components."""
    to = small(labels, FEW).select(F.col("v").alias("vid"), "c")
    return rows.join(to, "vid", "left").select(*rows.columns, F.coalesce("c", "vid").alias("comp"))


def _blocks(grouped: DataFrame, labels: DataFrame, leaf: int, block: int) -> DataFrame:
    """Rows (cell, vid, comp, side) that bring every component but the largest of a group together with all of the group."""
    rows = keep(_named(grouped, labels), "grouped-labelled")
    per = rows.groupBy("grp", "comp").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    shape = per.groupBy("grp").agg(F.max(F.struct("k", "comp")).alias("m"), F.sum("k").alias("all"), F.sum("n").alias("n"))
    shape = shape.withColumn("of", F.least(F.lit(block), F.greatest(F.lit(min(leaf, block)), F.floor(BLOCK_SHINGLES * F.col("all") / F.col("n")))))
    shape = shape.select("grp", "of", F.col("m.comp").alias("main"), F.col("m.k").alias("inside"), (F.col("all") - F.col("m.k")).alias("rest")).where("rest > 0")
    blocks = lambda n: F.ceil(F.col(n) / F.col("of")).cast("int")
    rows = rows.join(shape, "grp").withColumn("mb", F.greatest(blocks("inside"), F.lit(1))).withColumn("rb", blocks("rest"))
    spread = F.xxhash64("vid")
    others = F.pmod(spread, F.col("rb")).cast("int")
    cell = lambda left, right, kind: F.xxhash64("grp", left, right, F.lit(kind))
    main, rest = rows.where("comp = main"), rows.where("comp <> main")
    first = main.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("rb") - 1))).withColumn("y", F.pmod(spread, F.col("mb")).cast("int"))
    first = first.select(cell("x", "y", "m").alias("cell"), "vid", "comp", F.lit(1).alias("side"))
    second = rest.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("mb") - 1))).withColumn("x", others)
    second = second.select(cell("x", "y", "m").alias("cell"), "vid", "comp", F.lit(0).alias("side"))
    third = rest.withColumn("z", others).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("rb") - 1)))
    side = F.when(F.col("z") == F.col("y"), 2).when(F.col("z") < F.col("y"), 0).otherwise(1)
    third = third.select(cell(F.least("z", "y"), F.greatest("z", "y"), "r").alias("cell"), "vid", "comp", side.alias("side"))
    return first.unionByName(second).unionByName(third)


def _sets(k: int):
    def build(batches):
        for batch in batches:
            texts, vids = batch.column("text").to_pylist(), batch.column("vid").to_pylist()
            for at in range(0, len(texts), 256):
                sets = shingle_sets([words(t) for t in texts[at : at + 256]], k)
                yield pa.record_batch([pa.array(vids[at : at + 256], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["vid", "set"])

    return build


def _sets_of(ids: DataFrame, classes: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """vid, set: the shingles of kept ids (vid); a kept table. texts: doc, print, text."""
    one = keep(classes.select("vid", "doc", "print").join(small(ids, FEW), "vid"), "wanted-texts")
    own = texts.join(small(one, FEW), ["doc", "print"]).select("vid", "text")
    # Of repeated rows one is as good as another.
    # Kept, so that the join of its readers has nothing but shuffles under it and Spark may split a class that is in many cells.
    sets = keep(own.mapInArrow(_sets(k), "vid long, set binary").dropDuplicates(["vid"]), "sets")
    release(one)
    return sets


def _links(rows: DataFrame, classes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Kept links between components that rows (cell, vid, comp, grp, side) bring together."""
    dealt = rows.join(classes.select("vid", "n", "sig"), "vid").select(*_CELL).repartition("cell").sortWithinPartitions("cell", "vid")
    wanted = keep(dealt.mapInArrow(_wanted(percent), dealt.schema), "wanted")
    ids = keep(wanted.select("vid").distinct(), "wanted-ids")
    sets = _sets_of(ids, classes, texts, k)
    full = wanted.join(sets, "vid").select(*_CELL, "set").repartition("cell").sortWithinPartitions("cell", "vid")
    links = keep(full.mapInArrow(_confirm(percent), "a long, b long"), "links")
    release(wanted, ids, sets)
    return links


def _met(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Kept links between components that rows (cell, vid, comp, side) bring together, all of which are compared on full sets."""
    full = rows.join(sets, "vid").select("cell", "vid", "comp", "side", "set").repartition("cell").sortWithinPartitions("cell", "vid")
    return keep(full.mapInArrow(_compare(percent), "a long, b long"), "links")


def _grouped(large: DataFrame, classes: DataFrame, texts: DataFrame, labels: DataFrame, k: int, percent: int, leaf: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Labels after all pairs of the large nodes have met, and a kept table vid, grp: pairs of equal grp need not meet again."""
    near = keep(large.join(_hubs(large, classes, leaf), "node").select("hub", "vid").distinct(), "near")
    ids = keep(near.select("vid").distinct(), "near-ids")
    sets = _sets_of(ids, classes, texts, k)
    # First the hubs: what they hold together isn't looked at again.
    labels = _merge(labels, _met(_named(_star(near, leaf), labels), sets, percent))
    of = _named(near.select(F.col("hub").alias("vid")).distinct(), labels).select(F.col("vid").alias("hub"), F.col("comp").alias("grp"))
    sizes = sets.select("vid", (F.octet_length("set") / 8).cast("long").alias("n"))
    grouped = keep(near.join(of, "hub").select("grp", "vid").distinct().join(sizes, "vid"), "grouped")
    labels = _merge(labels, _met(_blocks(grouped, labels, leaf, block), sets, percent))
    mine = keep(grouped.groupBy("vid").agg(F.min("grp").alias("grp")), "groups")
    release(near, ids, sets, grouped)
    return labels, mine


def _shared(ready: DataFrame, reps: DataFrame) -> DataFrame:
    """Links between the classes of one doc_id: a star around the least."""
    held = ready.where("cls IS NOT NULL AND doc IS NOT NULL").select("doc", "cls")
    several = held.groupBy("doc").agg(F.min("cls").alias("x"), F.max("cls").alias("y")).where("x <> y").select("doc")
    mine = keep(held.join(several, "doc", "left_semi").distinct().join(reps.select("cls", "vid"), "cls").select("doc", "vid"), "shared-ids")
    least = mine.groupBy("doc").agg(F.min("vid").alias("a"))
    return mine.join(least, "doc").where("a < vid").select("a", F.col("vid").alias("b")).distinct()


def _labelled(rows: DataFrame, labels: DataFrame, groups: DataFrame | None) -> DataFrame:
    """Rows (cell, vid) with their components and groups, of cells that have several; a class of no group is its own."""
    rows = _named(rows.select("cell", "vid"), labels)
    if groups is None:
        named = rows.withColumn("grp", F.col("vid"))
    else:
        # Beside the numbers of rows, which are not negative.
        named = rows.join(small(groups, FEW), "vid", "left").select("cell", "vid", "comp", F.coalesce(-F.col("grp") - 1, "vid").alias("grp"))
    named = keep(named, "labelled")
    mixed = named.groupBy("cell").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("comp", "grp") for f in (F.min, F.max)])
    mixed = mixed.where("min_comp <> max_comp AND min_grp <> max_grp").select("cell")
    return named.join(mixed, "cell", "left_semi").withColumn("side", F.lit(2))


def _merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (v, c) after further kept links; both kept."""
    if links.isEmpty():
        return labels
    # A label is itself a link of a vertex with its component.
    return components(keep(labels.select(F.col("v").alias("a"), F.col("c").alias("b")).unionByName(links.select("a", "b")), "links"))


def linked(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, trees: int = TREES, leaf: int = LEAF, levels: int = LEVELS, block: int = BLOCK) -> DataFrame:
    """doc (the doc_id), print (a hash of the text), cls, n_shingles, component_id; a row per row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("print"), "text")
    ready = keep(rows.mapInArrow(_prepare(k), "doc long, print long, row long, cls binary, n long, sig binary"), "prepared")
    reps = ready.where("cls IS NOT NULL AND doc IS NOT NULL").groupBy("cls").agg(F.min(F.struct("doc", "print", "row")).alias("m"))
    reps = keep(reps.select("cls", F.col("m.row").alias("vid"), F.col("m.doc").alias("low")), "classes")
    classes = keep(ready.join(reps.select("vid"), ready["row"] == reps["vid"]).select("vid", "n", "sig", "doc", "print"), "signatures")
    cells, large = _cells(classes.select("vid", "sig"), trees, leaf, levels)
    cells = keep(cells, "cells")
    labels = components(keep(_shared(ready, reps), "links"))
    groups = None
    if large is not None:
        labels, groups = _grouped(large, classes, rows, labels, k, percent, leaf, block)
    labels = _merge(labels, _links(_labelled(cells.where("first"), labels, groups), classes, rows, k, percent))
    if trees > 1:
        labels = _merge(labels, _links(_labelled(cells.where("NOT first"), labels, groups), classes, rows, k, percent))
    release(cells)
    # Labels are rows' numbers: a component is named by the smallest doc_id of its classes.
    lows = reps.select(F.col("vid").alias("v"), "low").join(small(labels, FEW), "v")
    low = small(keep(lows.groupBy("c").agg(F.min("low").alias("__component")), "lows"), FEW)
    joined = small(keep(labels.join(low, "c").select("v", "__component"), "named"), FEW)
    named = reps.join(joined, reps["vid"] == joined["v"], "left").select(F.col("cls").alias("__cls"), F.coalesce("__component", "low").alias("component_id"))
    found = ready.select("doc", "print", "cls", F.col("n").alias("n_shingles"))
    full = found.where("cls IS NOT NULL")
    full = full.join(named, full["cls"] == named["__cls"], "left").select(*found.columns, F.when(F.col("doc").isNotNull(), F.col("component_id")).alias("component_id"))
    # Without words a row adds no link, but belongs to its doc_id's vertex.
    blank = found.where("cls IS NULL")
    other = full.join(blank.select("doc"), "doc", "left_semi").groupBy(F.col("doc").alias("__doc")).agg(F.min("component_id").alias("component_id"))
    blank = blank.join(other, blank["doc"] == other["__doc"], "left").select(*found.columns, F.coalesce("component_id", "doc").alias("component_id"))
    return full.unionByName(blank)


def digest(docs: DataFrame, **parameters) -> DataFrame:
    found = linked(docs, **parameters)
    return found.select(F.col("doc").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("doc") == F.col("component_id"), F.lit(True)).alias("kept"))


def apply(docs: DataFrame, k: int = 5, **parameters) -> DataFrame:
    """docs with one row of each component: of its smallest doc_id, the text with the smallest hash, of repeated rows one.

    A row without words stays. A row with a null id stays unless another row with an id, or a smaller hash, has its words.
    """
    found = keep(linked(docs, k=k, **parameters).where("cls IS NOT NULL").select("doc", "print", "cls", "component_id"), "found")
    first = found.where("doc IS NOT NULL").groupBy("component_id").agg(F.min(F.struct("doc", "print")).alias("first"))
    stays = first.select(F.col("first.doc").alias("doc"), F.col("first.print").alias("print"))
    free = found.groupBy("cls").agg(F.min("print").alias("print"), F.count("doc").alias("n")).where("n = 0").select(F.lit(None).cast("long").alias("doc"), "print")
    # Null ids are joined as equal.
    pair = lambda left, right: left["doc"].eqNullSafe(right["doc"]) & left["print"].eqNullSafe(right["print"])
    rows, staying = found.groupBy("doc", "print").agg(F.count("*").alias("n")), stays.unionByName(free)
    gone = small(keep(rows.join(staying, pair(rows, staying), "left_anti").select("doc", "print"), "gone"), FEW)
    twice = keep(rows.where("n > 1").join(staying, pair(rows, staying), "left_semi").select("doc", "print"), "repeated")
    inner = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("__row"), F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("print"))
    left = inner.join(gone, pair(inner, gone), "left_anti")
    if not twice.isEmpty():
        few = small(twice, FEW)
        same = left.join(few, pair(left, few), "left_semi").groupBy("doc", "print").agg(F.first("__row").alias("__row"))
        left = left.join(few, pair(left, few), "left_anti").unionByName(same.select("__row", "doc", "print"))
    return left.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns])
