"""Near-duplicate embeddings by cells around centres drawn from a bounded sample.

Every vector has its home in the cell of its most similar centre and visits the cells whose border to its own is near. A cell compares
its residents and its visitors with its residents by blocks of a matrix product, in single precision with a bound on its error; pairs
within the bound are compared in double precision. Two vectors that visit each other count in the cell of the lower number, so the
number of links needs no list of pairs: blocks return sums for each vector, and one linking edge less than a linked group has vectors.

How near a border must be is measured on pairs made at the threshold, of which RECALL have to meet; beyond half the distance of such a
pair nothing is missed, so visits end there. Dense groups in the sample get one centre, at their middle, and no second centre beside it:
a border doesn't part them. Vectors within half the threshold's angle of a centre (its core) link with each other for certain and are
only counted; other cells of many vectors are compared in pairs of blocks over many tasks. Equal vectors are one class from the start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .components import components
from .kernels import U64, splitmix

TREES = 8
SAMPLE = 16384
#: Share of pairs at the threshold that must meet in a cell, and how many are made to measure it.
RECALL = 0.99
MADE = 4096
#: Rows of a cell: at least, and at most for vectors of 64 components; most centres; cells wanted for the sake of many tasks.
LEAST = 512
MOST = 16384
CENTRES = 4096
TASKS = 128
#: Dense groups: rows of the sample that are compared, and links from which on a row is the middle of a group.
SEEN = 8192
CLOSE = 8
#: Numbers of a matrix held at a time.
HELD = 1 << 22
#: Rows and columns of a product: what a core's own cache holds.
TILE = 512, 2048
NONE, VISITS, RESIDES, CORE = 0, 1, 2, 3


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _slack(d: int) -> float:
    """A bound on the error of a single-precision product of two unit vectors."""
    return 1e-6 + 1.2e-7 * d


def _blobs(x: np.ndarray) -> pa.Array:
    size = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x).tobytes())])


def _matrix(blobs: pa.Array, wide: bool) -> np.ndarray:
    """Rows of equally long blobs."""
    if not len(blobs):
        return np.empty((0, 1))
    _, ends, data = blobs.buffers()
    start, end = np.frombuffer(ends, np.int32)[[blobs.offset, blobs.offset + len(blobs)]]
    return np.frombuffer(data, np.uint8)[start:end].view(np.float64 if wide else np.float32).reshape(len(blobs), -1)


def _lists(owner: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """Values, dealt to n rows by ascending owner, as blobs of 32-bit integers."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]) * 4
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values.astype(np.int32).tobytes())])


CLEAN = "id long, d int, key binary, k long, x binary"


def _clean(wide: bool):
    """Sound vectors with their digest: bytes as given if single precision, else divided by the largest component, so that no square overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            known = ids.is_valid().to_numpy(zero_copy_only=False) & lists.is_valid().to_numpy(zero_copy_only=False)
            long = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            for d in np.unique(long[known]):
                if d == 0:
                    continue
                rows = np.flatnonzero(known & (long == d))
                most = max(1, HELD // int(d))
                for at in range(0, len(rows), most):
                    own = rows[at : at + most]
                    flat = lists.take(pa.array(own)).flatten()
                    holes = flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, d).any(1)
                    given = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).reshape(-1, d)
                    sound = ~holes & np.isfinite(given).all(1) & (given != 0).any(1)
                    own, given = own[sound], given[sound] + given.dtype.type(0)
                    if not len(own):
                        continue
                    scaled = given.astype(np.float64)
                    scaled = scaled / np.abs(scaled).max(1, keepdims=True) + 0.0
                    keys = [hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in scaled]
                    heads = np.frombuffer(b"".join(keys), np.int64)[::2]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(own)), pa.array(np.full(len(own), d, np.int32)), pa.array(keys, pa.binary()), pa.array(heads), _blobs(scaled if wide else given)], names=["id", "d", "key", "k", "x"])

    return run


def _centres(points: np.ndarray, count: int, threshold: float, trees: int, seed: int) -> tuple[np.ndarray, float]:
    """Centres (single precision), and how near a border a vector visits: of some draws the one with the fewest visits."""
    rng = np.random.default_rng(seed)
    apart = 2 * threshold - 1  # a second centre as near as this would part a group that is dense at the threshold
    few = points[: min(SEEN, len(points))].astype(np.float32)
    close = np.concatenate([few[k : k + 512] @ few.T >= threshold for k in range(0, len(few), 512)])
    degree = close.sum(1)
    middles = np.empty((0, points.shape[1]))
    for k in np.argsort(-degree, kind="stable")[: (degree > CLOSE).sum()]:
        if len(middles) >= count:
            break
        middle = _unit(points[: len(few)][close[k]].mean(0, keepdims=True))
        if not len(middles) or (middles @ middle[0]).max() < apart:
            middles = np.concatenate([middles, middle])
    x, drawable = points[-MADE:], points[: -MADE if len(points) >= max(2 * MADE, count + MADE) else None]  # a centre is no typical row
    # directions spread as the sample is; those to single rows would lean to the centres, which are rows themselves
    z = rng.standard_normal((len(x), min(MADE, len(points)))) @ points[rng.choice(len(points), min(MADE, len(points)), replace=False)]
    z = z - (z * x).sum(1, keepdims=True) * x
    some = np.linalg.norm(z, axis=1) > 1e-6
    x, z = x[some], _unit(z[some])
    y = threshold * x + np.sqrt(max(0.0, 1 - threshold**2)) * z
    exact = np.sqrt(max(0.0, 2 - 2 * threshold)) / 2
    best, least = None, np.inf
    for _ in range(max(1, trees)):
        drawn = middles
        for c in drawable[rng.permutation(len(drawable))[:count]]:
            if len(drawn) >= count:
                break
            if not len(drawn) or (drawn @ c).max() < apart:
                drawn = np.concatenate([drawn, c[None]])
        between = np.sqrt(np.maximum(2 - 2 * (drawn @ drawn.T), 1e-12))
        sx, sy, at = x @ drawn.T, y @ drawn.T, np.arange(len(x))
        hx, hy = sx.argmax(1), sy.argmax(1)
        far = np.minimum(sx[at, hx] - sx[at, hy], sy[at, hy] - sy[at, hx]) / between[hx, hy]
        near = float(min(exact, np.quantile(np.where(hx == hy, 0, far), RECALL))) + 1e-5 if len(x) else exact
        visits = (sx.max(1)[:, None] - sx <= near * between[hx]).sum() if len(x) else 0
        if visits < least:
            best, least = (drawn.astype(np.float32), near), visits
    return best


def _ready(models: dict) -> dict:
    """With the distances between the centres, which are not shipped."""
    return {d: (centres, near, np.sqrt(np.maximum(2 - 2 * (centres @ centres.T), 1e-12))) for d, (centres, near) in models.items()}


def _assign(x: np.ndarray, model: tuple[np.ndarray, float, np.ndarray] | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of single-precision unit rows: home cell, whether in its core, and (row, cell) of the visits by ascending row."""
    if model is None:
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool), np.empty(0, np.int64), np.empty(0, np.int64)
    centres, near, between = model
    inner = np.sqrt((1 + threshold) / 2) + 2 * _slack(x.shape[1])
    homes, cores, rows, cells = [], [], [], []
    step = max(1, HELD // len(centres))
    for at in range(0, len(x), step):
        likeness = x[at : at + step] @ centres.T
        home = likeness.argmax(1)
        own = likeness[np.arange(len(home)), home]
        row, cell = np.nonzero(own[:, None] - likeness <= np.float32(near) * between[home])
        other = cell != home[row]
        homes.append(home)
        cores.append((x[at : at + step].astype(np.float64) * centres[home]).sum(1) >= inner)  # row by row: the same in every run
        rows.append(row[other] + at)
        cells.append(cell[other])
    return tuple(np.concatenate(v) for v in (homes, cores, rows, cells))


def _placed(batch: pa.RecordBatch, models: dict, threshold: float, wide: bool):
    """(d, rows, assignment) of a batch (d, id, k, copies, x), length by length."""
    lengths = batch.column(0).to_numpy()
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        most = max(1, 4 * HELD // int(d))
        for at in range(0, len(rows), most):
            part = batch.take(pa.array(rows[at : at + most]))
            x = _unit(_matrix(part.column(4), wide).astype(np.float64)).astype(np.float32)
            yield int(d), part, _assign(x, models.get(int(d)), threshold)


COUNTS = "d int, cell int, residents long, visitors long, core long, copies long, least long"


def _count(shipped, threshold: float, wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = _ready(shipped.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            for d, part, (home, core, _, cell) in _placed(batch, models, threshold, wide):
                n = int(max(home.max(), cell.max() if len(cell) else 0)) + 1
                copies = np.zeros(n, np.int64)
                np.add.at(copies, home[core], part.column(3).to_numpy()[core])
                least = np.full(n, np.iinfo(np.int64).max)
                np.minimum.at(least, home[core], part.column(1).to_numpy()[core])
                residents, visitors, cores = (np.bincount(c, minlength=n) for c in (home[~core], cell, home[core]))
                some = np.flatnonzero(residents + visitors + cores)
                columns = [np.full(len(some), d, np.int32), some.astype(np.int32), *(v[some].astype(np.int64) for v in (residents, visitors, cores, copies, least))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["d", "cell", "residents", "visitors", "core", "copies", "least"])

    return run


DEALT = "d int, cell int, a int, b int, role byte, id long, k long, copies long, home int, visits binary, x binary"


def _block(k: np.ndarray, salt: int, blocks: np.ndarray) -> np.ndarray:
    return (splitmix(k.astype(np.int64).view(U64) + U64(salt)) % blocks.astype(U64)).astype(np.int64)


def _deal(shipped, threshold: float, wide: bool):
    """Each vector to the pairs of blocks of its cells. Side a holds residents outside the core and visitors, side b all residents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, plans = _ready(shipped.value[0]), shipped.value[1]
        for batch in batches:
            if not batch.num_rows:
                continue
            for d, part, (home, core, row, cell) in _placed(batch, models, threshold, wide):
                n = part.num_rows
                plan = plans[d]  # cell: blocks of a, blocks of b
                rows = np.concatenate([np.arange(n), row])
                cells = np.concatenate([home, cell])
                role = np.concatenate([np.where(core, CORE, RESIDES), np.full(len(row), VISITS)])
                na, nb = plan[cells, 0], plan[cells, 1]  # 1 at least
                keys = part.column(2).to_numpy()[rows]
                a, b = _block(keys, 1, na), _block(keys, 2, nb)
                in_a, in_b = role != CORE, role != VISITS
                times_a, times_b = np.where(in_a, nb, 0), np.where(in_b, na, 0)
                one, two = np.repeat(np.arange(len(rows)), times_a), np.repeat(np.arange(len(rows)), times_b)
                other_a = np.arange(len(one)) - np.repeat(np.cumsum(times_a) - times_a, times_a)
                other_b = np.arange(len(two)) - np.repeat(np.cumsum(times_b) - times_b, times_b)
                fresh = ~(in_a[two] & (a[two] == other_b))  # a resident outside the core is in a and b of this one
                two, other_b = two[fresh], other_b[fresh]
                at = np.concatenate([one, two])
                to_a, to_b = np.concatenate([a[one], other_b]), np.concatenate([other_a, b[two]])
                visits = _lists(row, cell, n)
                none = pa.scalar(b"", pa.binary())
                for k in range(0, len(at), 8192):
                    s = at[k : k + 8192]
                    take = pa.array(rows[s])
                    stays = pa.array(role[s] != VISITS)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(s), d, np.int32)), pa.array(cells[s].astype(np.int32)), pa.array(to_a[k : k + 8192].astype(np.int32)), pa.array(to_b[k : k + 8192].astype(np.int32)),
                            pa.array(role[s].astype(np.int8)), part.column(1).take(take), part.column(2).take(take), part.column(3).take(take), pa.array(home[rows[s]].astype(np.int32)),
                            pc.if_else(stays, visits.take(take), none), part.column(4).take(take),
                        ],
                        names=["d", "cell", "a", "b", "role", "id", "k", "copies", "home", "visits", "x"],
                    )

    return run


def _unite(label: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Labels (the least row of each linked group) after the links one[i], two[i]."""
    while True:
        a, b = label[one], label[two]
        new = a != b
        if not new.any():
            return label
        one, two, a, b = one[new], two[new], a[new], b[new]
        parent = np.arange(len(label))
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label = parent[label]


def _compare(shipped, threshold: float, wide: bool):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        d, cell, block_a, block_b = (x.as_py() for x in key)
        rows = rows.combine_chunks().to_batches()[0]
        role, ids, ks, copies, home = (rows[c].to_numpy() for c in ("role", "id", "k", "copies", "home"))
        na, nb, core_copies, core_least = (int(v) for v in shipped.value[1][d][cell])
        raw = _matrix(rows["x"], wide)
        a = np.flatnonzero((role != CORE) & (_block(ks, 1, np.full(len(ks), na)) == block_a))
        b = np.flatnonzero((role != VISITS) & (_block(ks, 2, np.full(len(ks), nb)) == block_b))
        a = a[np.lexsort((home[a], role[a]))]  # visitors first, by home
        place = np.full(len(ks), -1)
        place[b] = np.arange(len(b))
        count, label = np.zeros(len(ks), np.int64), np.arange(len(ks))
        size = pc.binary_length(rows["visits"]).to_numpy() // 4
        visited = np.frombuffer(b"".join(rows["visits"].to_pylist()), np.int32)
        visitor = np.repeat(place, size)  # column of side b that visits that cell
        order = np.argsort(np.where(visitor < 0, np.iinfo(np.int32).max, visited), kind="stable")[: int((visitor >= 0).sum())]
        visited, visitor = visited[order], visitor[order]
        low, high = threshold - _slack(d), threshold + _slack(d)
        many = copies.sum() >= 1 << 24  # more than single precision counts
        side_b = np.empty((len(b), d), np.float32)
        for at in range(0, len(b), 8192):
            side_b[at : at + 8192] = _unit(raw[b[at : at + 8192]].astype(np.float64))
        held = np.empty((TILE[0], min(TILE[1], max(1, len(b)))), np.float32)  # fresh pages for every product would cost more than the product
        links, waiting = [], 0
        for at in range(0, len(a), TILE[0]):
            rows_a = a[at : at + TILE[0]]
            side_a = _unit(raw[rows_a].astype(np.float64)).astype(np.float32)
            for left in range(0, len(b), TILE[1]):
                cols = b[left : left + TILE[1]]
                dots = np.matmul(side_a, side_b[left : left + TILE[1]].T, out=held[: len(rows_a), : len(cols)])
                column = place[rows_a] - left
                itself = np.flatnonzero((column >= 0) & (column < len(cols)))
                dots[itself, column[itself]] = -2
                hit = np.flatnonzero(dots.max(1) >= low)
                if not len(hit):
                    continue
                dots, own = dots[hit], rows_a[hit]
                visits = role[own] == VISITS
                for h in np.unique(home[own[visits & (home[own] < cell)]]):
                    both = visitor[slice(*np.searchsorted(visited, [h, h + 1]))] - left  # these visit the cell h as well and count there
                    same = np.flatnonzero((home[own] == h) & visits)
                    dots[same[0] : same[-1] + 1, both[(both >= 0) & (both < len(cols))]] = -2
                close = dots >= low
                i, j = np.nonzero(close & (dots < high))
                for part in range(0, len(i), max(1, HELD // d)):
                    u, v = i[part : part + max(1, HELD // d)], j[part : part + max(1, HELD // d)]
                    one, two = (_unit(raw[r].astype(np.float64)) for r in (own[u], cols[v]))
                    wrong = np.einsum("ij,ij->i", one, two) < threshold
                    close[u[wrong], v[wrong]] = False
                # two residents outside the core meet a second time, the other way round; all others count for both here
                if np.count_nonzero(close) < 0.02 * close.size:
                    i, j = np.nonzero(close)
                    one, two = own[i], cols[j]
                    np.add.at(count, one, copies[two])
                    once = visits[i] | (role[two] == CORE)
                    np.add.at(count, two[once], copies[one[once]])
                else:
                    inner = np.flatnonzero(role[cols] == CORE)
                    weight = close.astype(np.float64 if many else np.float32)
                    count[own] += np.rint(weight @ copies[cols].astype(weight.dtype)).astype(np.int64)
                    count[cols] += np.rint((copies[own] * visits).astype(weight.dtype) @ weight).astype(np.int64)
                    count[cols[inner]] += np.rint((copies[own] * ~visits).astype(weight.dtype) @ weight[:, inner]).astype(np.int64)
                    i, j = np.nonzero(close & (label[own][:, None] != label[cols]))
                    one, two = own[i], cols[j]
                links.append((one, two))
                waiting += len(one)
                if waiting > len(label):
                    label, links, waiting = _unite(label, *(np.concatenate(v) for v in zip(*links, strict=True))), [], 0
        if waiting:
            label = _unite(label, *(np.concatenate(v) for v in zip(*links, strict=True)))
        if block_a == 0:
            core = role == CORE
            count[core] += core_copies - copies[core]
        linked = np.flatnonzero(label != np.arange(len(label)))
        counted = np.flatnonzero(count)
        edges_a, edges_b = [ids[label[linked]]], [ids[linked]]
        if block_a == 0:
            edges_a.append(np.full(int(core.sum()), core_least))
            edges_b.append(ids[core])
        edges_a, edges_b = np.concatenate(edges_a), np.concatenate(edges_b)
        real = edges_a != edges_b
        edges_a, edges_b = edges_a[real], edges_b[real]
        return pa.table(
            {
                "a": pa.array(np.concatenate([ids[counted], edges_a]), pa.int64()), "k": pa.array(np.concatenate([ks[counted], np.zeros(len(edges_a), np.int64)]), pa.int64()),
                "b": pa.array(np.concatenate([np.zeros(len(counted), np.int64), edges_b]), pa.int64()), "n": pa.array(np.concatenate([count[counted], np.zeros(len(edges_a), np.int64)]), pa.int64()),
            }
        )

    return run


def near_duplicates(
    embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, trees: int = TREES, target: int | None = None, leaf: int | None = None, sample: int = SAMPLE, seed: int = 5
) -> DataFrame:
    """One row per row of embeddings: the id, n_links (other vectors linked directly), component_id (least id reachable), kept.

    Two vectors link if their cosine, in double precision, is threshold or more; a link is found if one's home is among the cells of the other.
    trees: draws of centres to choose from; target: rows of a cell; leaf: rows of a block of a large cell; sample: rows the centres come from.
    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and so do those of different
    lengths. Equal vectors count as links of each other. Rows with one id are one node, each row with its own links; a null id links with nothing:
    component_id null, kept true. Other columns don't matter. An empty table gives an empty result.
    """
    spark = embeddings.sparkSession
    wide = embeddings.schema[vector_col].dataType.simpleString() != "array<float>"
    slim = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>" if wide else "array<float>").alias("v"))
    clean = slim.mapInArrow(_clean(wide), CLEAN)
    keys = cut(clean.select("id", "d", "key", "k"))
    classes = keys.groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("d").alias("d")).filter("copies > 1")
    classes = cut(classes)
    alone = classes.limit(1).count() == 0
    if alone:
        unique = clean.withColumn("copies", F.lit(1).cast("long"))
    else:
        own = clean.join(classes.drop("d"), "key", "left").filter("rep is null or id = rep")
        again = cut(keys.join(classes.drop("d"), "key").filter("id = rep").groupBy("key").count().filter("count > 1").select("key"))  # a row and its id repeated
        if again.limit(1).count():
            own = own.join(again, "key", "left_anti").unionByName(own.join(again, "key", "left_semi").dropDuplicates(["key"]))
        unique = own.withColumn("copies", F.coalesce("copies", F.lit(1)))
    unique = unique.select("d", "id", "k", "copies", "x")

    sizes = keys.groupBy("d").agg(F.count(F.lit(1)).alias("n")).join(classes.groupBy("d").agg(F.sum(F.col("copies") - 1).alias("more")), "d", "left")
    lengths = {r["d"]: r["n"] - (r["more"] or 0) for r in sizes.toLocalIterator()}  # distinct vectors of each length
    rows_of = {d: target or min(max(n // TASKS, LEAST), max(2048, min(MOST, MOST * 64 // d))) for d, n in lengths.items()}
    count_of = {d: min(n // rows_of[d], CENTRES, sample) for d, n in lengths.items()}
    rates = {d: min(1.0, min(sample, (1 << 25) // d) / lengths[d]) for d, c in count_of.items() if c > 1}
    models = {}
    for d, rate in rates.items():
        some = unique.filter(F.col("d") == d).filter(F.xxhash64("k", F.lit(seed)).cast("double") < F.lit((rate - 0.5) * 2.0**64)).orderBy("k", "id").select("x")
        points = _matrix(pa.array([bytes(r["x"]) for r in some.toLocalIterator()], pa.binary()), wide).astype(np.float64)  # about sample rows
        if len(points) > 1:
            models[d] = _centres(_unit(points), count_of[d], threshold, trees, seed)
    shipped = spark.sparkContext.broadcast(models)
    counts = unique.mapInArrow(_count(shipped, threshold, wide), COUNTS).groupBy("d", "cell")
    counts = counts.agg(*(F.sum(c).alias(c) for c in ("residents", "visitors", "core", "copies")), F.min("least").alias("least"))
    plans = {d: np.tile([1, 1, 0, 0], (len(models[d][0]) if d in models else 1, 1)) for d in lengths}
    for r in counts.toLocalIterator():  # a row for each cell
        most = rows_of[r["d"]]
        na, nb = r["residents"] + r["visitors"], r["residents"] + r["core"]
        plans[r["d"]][r["cell"]] = [max(1, -(-na // (leaf or max(16384, 8 * most)))), max(1, -(-nb // (leaf or max(8192, 4 * most)))), r["copies"], r["least"] if r["core"] else 0]
    ready = spark.sparkContext.broadcast((models, plans))
    dealt = unique.mapInArrow(_deal(ready, threshold, wide), DEALT)
    found = cut(dealt.groupBy("d", "cell", "a", "b").applyInArrow(_compare(ready, threshold, wide), "a long, k long, b long, n long"))

    total = found.filter("n > 0").groupBy("a", "k").agg(F.sum("n").alias("n"))
    links = found.filter("n = 0").select("a", "b").distinct()
    member = keys.join(classes.drop("d"), "key", "left").select("id", "k", "key", F.coalesce("rep", "id").alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies"))
    copies = member.filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    placed = components(links.union(copies)).withColumnRenamed("id", "cid")
    tied = member.join(total.withColumnRenamed("k", "kk"), (F.col("rep") == F.col("a")) & (F.col("k") == F.col("kk")), "left")
    own = tied.groupBy("id").agg(F.max(F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")).withColumnRenamed("id", "nid")
    out = slim.select("id").join(own, F.col("id") == F.col("nid"), "left").join(placed, F.col("id") == F.col("cid"), "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
