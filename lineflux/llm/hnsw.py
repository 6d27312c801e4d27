"""Near-duplicate embeddings by hierarchical navigable small-world graphs, one per shard.

Equal vectors are one class. The classes of a label are dealt into shards, each shard becomes a graph, and every class queries
every shard of its label. A graph is audited with planted links: queries turned away from known nodes to exactly the least cosine,
which must find them. Beams widen until the audit passes; a graph that fails at the widest beam answers by products with the whole
shard. Queries whose beam is full of links, and blocks in which a sample against brute force misses links, are answered by products
too. Links are verified by cosine in double precision, and their components are united.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, few, ship, store, table

#: Vectors of a shard (16 MB at 128 dimensions), neighbours of a node (twice that on the ground layer), and beam widths for
#: building and searching. A shard of WIDEST vectors or fewer needs no walk.
SHARD, LINKS, BUILD_BEAM, BEAM, WIDEST = 16_384, 12, 48, 32, 256
#: Queries of a block, blocks that share one copy of a graph, queries walked at once, and queries of a block that are audited.
BLOCK, PER_GRAPH, AT_ONCE, AUDITED = 2048, 16, 256, 48
#: Links that are verified at once.
PAIRS = 200_000
#: Planted links of a graph's audit, and the share of links that an audit must find.
PLANTED, RECALL = 1000, 0.999
FEW_KEYS = 400_000


class Graph:
    """A navigable small-world graph over the rows of x (unit float32 vectors). layers: neighbour tables, ground first; members: the
    rows on each layer; -1 fills unused places."""

    def __init__(self, x: np.ndarray, layers: list[np.ndarray] | None = None, members: list[np.ndarray] | None = None):
        self.x, self.layers, self.members = x, layers or [], members or []

    @classmethod
    def build(cls, x: np.ndarray, seed: int = 7) -> Graph:
        n, g = len(x), cls(x)
        rng = np.random.default_rng(seed)
        height = np.minimum((-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(int), 4)
        top = int(height.max()) if n else 0
        g.members = [np.flatnonzero(height >= k) for k in range(top + 1)]
        g.layers = [np.full((n, 2 * LINKS if k == 0 else LINKS), -1, np.int32) for k in range(top + 1)]
        for k in range(top, -1, -1):
            order = rng.permutation(g.members[k])
            done = 0
            while done < len(order):
                size = min(max(64, done), 512, len(order) - done)
                g._insert(k, order[done : done + size], order[:done])
                done += size
        return g

    def _insert(self, k: int, new: np.ndarray, old: np.ndarray) -> None:
        """Add nodes to layer k: candidates from a beam search and from their own batch, then diverse neighbours."""
        q = self.x[new]
        peers = q @ q.T
        np.fill_diagonal(peers, -2)
        near = np.argsort(-peers, axis=1)[:, :BUILD_BEAM]
        ids, sims = new[near], np.take_along_axis(peers, near, 1)
        ids = np.where(sims > -2, ids, -1)
        if len(old):
            start = self._enter(q, k, old)
            more, s = self.beam(k, q, start, BUILD_BEAM)
            ids, sims = np.concatenate([ids, more], 1), np.concatenate([sims, s], 1)
            best = np.argsort(-sims, axis=1)[:, :BUILD_BEAM]
            ids, sims = np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)
        chosen = self._diverse(ids, sims, LINKS)
        table_ = self.layers[k]
        table_[new, : chosen.shape[1]] = chosen
        # the other direction; a full node keeps a diverse choice of its old and new neighbours
        source = np.repeat(new, chosen.shape[1])[chosen.ravel() >= 0]
        target = chosen.ravel()[chosen.ravel() >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        width = table_.shape[1]
        for i in range(0, len(nodes), AT_ONCE):
            node, f, c = nodes[i : i + AT_ONCE], first[i : i + AT_ONCE], count[i : i + AT_ONCE]
            both = np.full((len(node), width + int(c.max())), -1)
            both[:, :width] = table_[node]
            within = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            both[np.repeat(np.arange(len(node)), c), width + within] = source[np.repeat(f, c) + within]
            both = np.sort(both, axis=1)
            both[:, 1:] = np.where(both[:, 1:] == both[:, :-1], -1, both[:, 1:])
            s = np.where(both >= 0, np.einsum("nd,nkd->nk", self.x[node], self.x[np.maximum(both, 0)]), -2.0)
            best = np.argsort(-s, axis=1)[:, : 2 * width]
            kept = self._diverse(np.take_along_axis(both, best, 1), np.take_along_axis(s, best, 1), width)
            table_[node] = -1
            table_[node, : kept.shape[1]] = kept

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of candidates by falling similarity, those nearer to the node than to any one chosen before; then the nearest rest."""
        v = self.x[np.maximum(ids, 0)]
        between = v @ v.transpose(0, 2, 1)
        good = ids >= 0
        keep = np.zeros_like(good)
        for j in range(ids.shape[1]):
            blocked = (keep[:, :j] & (between[:, :j, j] > sims[:, j : j + 1])).any(1)
            keep[:, j] = good[:, j] & ~blocked & (keep.sum(1) < most)
        rank = np.where(keep, 0, np.where(good, 1, 2)) * ids.shape[1] + np.arange(ids.shape[1])
        best = np.argsort(rank, axis=1)[:, :most]
        return np.take_along_axis(np.where(good, ids, -1), best, 1)

    def _enter(self, q: np.ndarray, k: int, old: np.ndarray | None = None) -> np.ndarray:
        """An entry to layer k for each query, walking down from the top."""
        start = None
        for layer in range(len(self.layers) - 1, k, -1):
            at = self.members[layer]
            if len(at):
                start = np.full((len(q), 1), at[0]) if start is None else start
                start = self.beam(layer, q, start, 1)[0]
        if start is None:
            start = np.full((len(q), 1), old[0] if old is not None else self.members[k][0])
        if old is not None:
            start = np.concatenate([start, np.full((len(q), 1), old[0])], 1)
        return start

    def beam(self, k: int, q: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The `width` best nodes of a beam search of layer k for all queries at once: ids (-1 where fewer) and similarities."""
        out = [self._beam(k, q[i : i + AT_ONCE], start[i : i + AT_ONCE], width) for i in range(0, len(q), AT_ONCE)]
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])

    def _beam(self, k: int, q: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        n, rows = len(q), np.arange(len(q))[:, None]
        seen = np.zeros((n, len(self.x) + 1), bool)  # the last place takes the -1 entries
        seen[:, -1] = True
        ids = np.where(seen[rows, start], -1, start)
        if start.shape[1] == 2:
            ids[:, 1] = np.where(start[:, 1] == start[:, 0], -1, ids[:, 1])
        sims = np.where(ids >= 0, np.einsum("nd,nkd->nk", q, self.x[np.maximum(ids, 0)]), -2.0).astype(np.float32)
        seen[rows, ids] = True
        open_ = ids >= 0
        step = 1 if width == 1 else 4
        while True:
            score = np.where(open_, sims, -3)
            pick = np.argsort(-score, axis=1)[:, :step]
            live = np.take_along_axis(open_, pick, 1)
            go = np.flatnonzero(live.any(1))
            if not len(go):
                return ids, sims
            node = np.where(live[go], np.take_along_axis(ids[go], pick[go], 1), -1)
            open_[go[:, None], pick[go]] = False
            new = np.where(node[:, :, None] >= 0, self.layers[k][np.maximum(node, 0)], -1).reshape(len(go), -1)
            new = np.sort(new, axis=1)
            new[:, 1:] = np.where(new[:, 1:] == new[:, :-1], -1, new[:, 1:])
            new = np.where(seen[go[:, None], new], -1, new)
            seen[go[:, None], new] = True
            s = np.where(new >= 0, np.einsum("nd,nkd->nk", q[go], self.x[np.maximum(new, 0)]), -2.0).astype(np.float32)
            all_ids, all_s = np.concatenate([ids[go], new], 1), np.concatenate([sims[go], s], 1)
            all_open = np.concatenate([open_[go], new >= 0], 1)
            best = np.argsort(-all_s, axis=1)[:, :width]
            size = best.shape[1]
            if ids.shape[1] < size:
                wider = size - ids.shape[1]
                ids = np.pad(ids, ((0, 0), (0, wider)), constant_values=-1)
                sims = np.pad(sims, ((0, 0), (0, wider)), constant_values=-2)
                open_ = np.pad(open_, ((0, 0), (0, wider)))
            ids[go], sims[go], open_[go] = -1, -2, False
            ids[go, :size] = np.take_along_axis(all_ids, best, 1)
            sims[go, :size] = np.take_along_axis(all_s, best, 1)
            open_[go, :size] = np.take_along_axis(all_open, best, 1) & (sims[go, :size] > -2)

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        return self.beam(0, q, self._enter(q, 0), width)


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def planted_width(g: Graph, x: np.ndarray, least: float) -> tuple[int | None, int, int]:
    """The first beam width at which g finds enough of its planted links (None: none does), and how many it found of how many."""
    rng = np.random.default_rng(11)
    node = rng.permutation(len(x))[:PLANTED]
    away = rng.normal(size=(len(node), x.shape[1]))
    away -= np.einsum("nd,nd->n", away, x[node])[:, None] * x[node]
    if x.shape[1] < 2 or not len(node):
        return None, 0, 0
    q = (least * x[node] + np.sqrt(max(0.0, 1 - least * least)) * unit(away)).astype(np.float32)
    width, found = BEAM, 0
    while width <= WIDEST and width < len(x):
        ids, _ = g.search(q, width)
        found = int((ids == node[:, None]).any(1).sum())
        if found >= RECALL * len(node):
            return width, found, len(node)
        width *= 2
    return None, found, len(node)


def links_of(g: Graph, x: np.ndarray, q: np.ndarray, least: float, own: np.ndarray, width: int | None, seen: dict | None = None):
    """(queries, nodes) of links with a cosine of `least` or more, some at a time. own: each query's own node, or -1. x and q in
    double precision. width: of the beams; None answers by products. seen counts queries, those answered exactly, and the audit."""
    margin = least - 1e-5  # the walk is in single precision
    found: dict[int, np.ndarray] = {}
    seen = {} if seen is None else seen

    def exact(rows):
        for k in range(0, len(rows), AT_ONCE):
            some = rows[k : k + AT_ONCE]
            a, b = np.nonzero(q[some] @ x.T >= margin)
            found.update(zip(some.tolist(), np.split(b.astype(np.int32), np.searchsorted(a, np.arange(1, len(some))))))

    todo = np.arange(len(q))
    if width is not None and width < len(x):
        ids, sims = g.search(q.astype(np.float32), width)
        found = {i: row[(row >= 0) & (s >= margin)] for i, (row, s) in enumerate(zip(ids, sims))}
        walked = {i: set(found[i].tolist()) for i in np.random.default_rng(7).permutation(len(q))[:AUDITED].tolist()}
        full = sims[:, -1] >= margin if ids.shape[1] == width else np.zeros(len(q), bool)
        exact(np.array(sorted(walked), int))
        truth = {i: {j for j in found[i].tolist() if x[j] @ q[i] >= least and j != own[i]} for i in walked if not full[i]}
        wanted, got = sum(map(len, truth.values())), sum(len(t & walked[i]) for i, t in truth.items())
        seen["wanted"], seen["got"] = seen.get("wanted", 0) + wanted, seen.get("got", 0) + got
        todo = np.flatnonzero(full) if got >= RECALL * wanted else todo
        todo = todo[[i not in walked for i in todo.tolist()]] if len(todo) else todo
    exact(todo)
    seen["queries"], seen["exact"] = seen.get("queries", 0) + len(q), seen.get("exact", 0) + len(todo)
    count = np.array([len(found[i]) for i in range(len(q))])
    part = (np.cumsum(count) - count) // PAIRS
    for rows in np.split(np.arange(len(q)), np.flatnonzero(np.diff(part)) + 1):
        a, b = np.repeat(rows, count[rows]), np.concatenate([found[i] for i in rows]).astype(np.int64)
        cos = np.einsum("nd,nd->n", q[a], x[b])
        good = (cos >= least) & (own[a] != b)
        yield a[good], b[good]


def forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Positions of links that join what all links join."""
    up: dict[int, int] = {}

    def root(i):
        while up.setdefault(i, i) != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    out = []
    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist())):
        i, j = root(i), root(j)
        if i != j:
            up[j] = i
            out.append(k)
    return out


STATS = ("queries", "exact", "wanted", "got", "planted", "refound")


def searched(classes: DataFrame, least: float, shard: int) -> DataFrame:
    """(a, b, n) of classes (grp, rep, copies, e): each class's number of links (b null) and links that join what all links join; and a
    row of STATS for each graph and share of its queries (a null).

    A shard is built by one task. Its vectors go on as blocks of queries; PER_GRAPH blocks at most meet one copy of a graph, so what is
    copied is a block for each graph of its label, and a graph for each PER_GRAPH blocks."""
    ship(classes.sparkSession)
    shards = store(classes.groupBy("grp").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards")), "shards")
    dealt = classes.join(few(shards, FEW_KEYS), "grp").withColumn("shard", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int"))
    names = ["grp", "shard", "block", "ids", "copies", "x", "layers", "members"]

    def build(t):
        import pyarrow as pa

        t = t.combine_chunks()
        x = np.array(t.column("e").to_pylist(), np.float64)
        x = unit(x / np.abs(x).max(axis=1, keepdims=True))
        g = Graph.build(x.astype(np.float32))
        ids, copies = t.column("rep").to_numpy(), t.column("copies").to_numpy()
        starts = range(0, len(x), BLOCK)
        rows = [(-1, ids.tobytes(), copies.tobytes(), x.tobytes(), [y.tobytes() for y in g.layers], [y.astype(np.int64).tobytes() for y in g.members])]
        rows += [(k // BLOCK, ids[k : k + BLOCK].tobytes(), None, x[k : k + BLOCK].tobytes(), None, None) for k in starts]
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary())]
        grp, part = t.column("grp")[0].as_py(), t.column("shard")[0].as_py()
        columns = [pa.array([grp] * len(rows), pa.string()), pa.array([part] * len(rows), pa.int32()), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))]
        return pa.Table.from_arrays(columns, names)

    built = store(dealt.select("grp", "shard", "rep", "copies", "e").groupBy("grp", "shard").applyInArrow(build, "grp string, shard int, block int, ids binary, copies binary, x binary, layers array<binary>, members array<binary>"), "graphs")

    def query(batches):
        import pyarrow as pa

        g = x = ids = copies = width = None
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c, r=r, batch=batch: batch.column(c)[r].as_py()
                if get("block") < 0:
                    ids, copies = np.frombuffer(get("ids"), np.int64), np.frombuffer(get("copies"), np.int64)
                    x = np.frombuffer(get("x"), np.float64).reshape(len(ids), -1)
                    g = Graph(x.astype(np.float32), [np.frombuffer(y, np.int32).reshape(len(ids), -1) for y in get("layers")], [np.frombuffer(y, np.int64) for y in get("members")])
                    width, refound, planted = planted_width(g, x, least)
                    yield made(pa, [], [], [], {"planted": planted, "refound": refound})
                    continue
                q_ids, at = np.frombuffer(get("ids"), np.int64), get("block") * BLOCK
                q = np.frombuffer(get("x"), np.float64).reshape(len(q_ids), -1)
                own = np.arange(at, at + len(q)) if get("shard") == get("of") else np.full(len(q), -1)
                seen: dict[str, int] = {}
                for a, b in links_of(g, x, q, least, own, width, seen):
                    count = np.bincount(a, copies[b], len(q)).astype(np.int64)
                    some = np.flatnonzero(count)
                    f = forest(q_ids[a], ids[b])
                    yield made(pa, [*q_ids[some].tolist(), *q_ids[a][f].tolist()], [None] * len(some) + ids[b][f].tolist(), [*count[some].tolist(), *[0] * len(f)])
                yield made(pa, [], [], [], seen)

    def made(pa, a, b, n, stats=None):
        rows = [None] if stats is not None else []
        columns = [pa.array([*a, *rows], pa.int64()), pa.array([*b, *rows], pa.int64()), pa.array([*n, *rows], pa.int64())]
        columns += [pa.array([None] * len(a) + [stats.get(k, 0)] if stats is not None else [None] * len(a), pa.int64()) for k in STATS]
        return pa.RecordBatch.from_arrays(columns, ["a", "b", "n", *STATS])

    # of: the shard that answers; share: the copy of its graph
    shares = built.where("block >= 0").groupBy("grp").agg(F.ceil(F.count("*") / PER_GRAPH).cast("int").alias("shares")).join(shards, "grp")
    shares = store(shares, "shares")
    graphs = built.where("block < 0").join(few(shares, FEW_KEYS), "grp").select(*names, F.col("shard").alias("of"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    blocks = built.where("block >= 0").join(few(shares, FEW_KEYS), "grp").select(*names, F.pmod(F.xxhash64("shard", "block"), F.col("shares")).cast("int").alias("share"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("of"))
    n = shares.agg(F.coalesce(F.sum(F.col("shares") * F.col("shards")), F.lit(1))).first()[0]
    tasks = graphs.unionByName(blocks).repartition(int(n), "grp", "of", "share").sortWithinPartitions("grp", "of", "share", "block", "shard")
    return store(tasks.mapInArrow(query, ", ".join(f"{c} long" for c in ("a", "b", "n", *STATS))), "links")


def audit(links: DataFrame) -> DataFrame:
    """One row: the share of queries answered by products, and the recall of planted and of sampled links (null without any)."""
    share = lambda a, b: F.sum(a) / F.nullif(F.sum(b), F.lit(0))
    return links.where("queries is not null").agg(F.sum("queries").alias("queries"), share("exact", "queries").alias("answered_exactly"), share("refound", "planted").alias("planted_recall"), share("got", "wanted").alias("sampled_recall"))


def classes_of(v: DataFrame) -> DataFrame:
    classes = v.where("cls is not null").groupBy("label", "cls").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("e").alias("e"))
    return store(classes.withColumn("grp", F.concat_ws(":", "label", F.size("e").cast("string"))), "vectors")


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, e, cls): cls tells the vectors that may link, by their components."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0)
    return v.withColumn("cls", F.when(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)), F.md5(F.array_join(F.col("e").cast("array<string>"), ","))))


def near_embeddings(vectors: DataFrame, least: float = 0.93, shard: int = SHARD) -> DataFrame:
    """vec_id, n_links, component_id, kept for vectors (vec_id, embedding, label).

    Vectors of one label and one length with a cosine of `least` or more are linked. A vector without a label, null, of norm zero, or
    with a null or non-finite component links with nothing. Rows of one vec_id are vectors of their own with a common id. An
    empty table gives no rows; other columns are ignored.
    """
    v = valid(vectors)
    classes = classes_of(v)
    got = searched(classes, least, shard).where("a is not null")
    counts = got.where("b is null").groupBy("a").agg(F.sum("n").alias("links"))
    counts, joined = store(counts, "counts"), store(components(got.where("b is not null").select("a", "b")), "joined")
    of = classes.select("label", "cls", "rep", "copies").join(few(counts, FEW_KEYS), F.col("rep") == F.col("a"), "left").join(few(joined, FEW_KEYS), F.col("rep") == F.col("id"), "left")
    of = store(of.select("label", "cls", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "classes")
    out = v.select("vec_id", "label", "cls").join(of, ["label", "cls"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op7_near_embeddings(spark, sf_dir: str) -> DataFrame:
    return near_embeddings(table(spark, sf_dir, "embeddings"))
